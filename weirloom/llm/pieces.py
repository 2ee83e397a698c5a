"""SentencePiece encoding and decoding with N-best segmentations.

A text is a lattice over the vocabulary's pieces: every piece that matches at a place is an
edge with the piece's score; a character that no single-character piece covers is an edge
of its own, UNKNOWN_PENALTY below the lowest score, that stands for the pieces of its UTF-8
bytes. Viterbi runs forward and leaves at each place the best score from the start. These
scores are an exact estimate of what is left for a search from the end backward: A* pops
whole segmentations in order of score, and no place needs to be popped more than N times.

White space is escaped as U+2581 and one is put before the text, as in the library's own
models; a U+2581 of the text itself is unknown, so it becomes bytes and decoding gives every
text back. No piece of the vocabulary may cross the start of a run of spaces (checked when
it is loaded), so the lattice falls apart into words there. A distinct word's best
segmentation and the loss of its second best come from Viterbi scores of both directions; a
text's N best combine its words' lists, in which only the N - 1 words with the smallest loss
for their second choice can differ, so A* runs for those.

The vocabulary's path is a parameter; the driver reads it and broadcasts the pieces (under
2 MB for 32,000). Executors keep word results up to CACHE_WORDS.

Defined results: null text has null ids and score and no pieces; empty text has no pieces and
score 0; fewer than N segmentations give fewer scores; ties are broken by place, then by
piece; repeated rows get equal results; an empty table gives an empty one; other columns are
kept, those with the names of the result's are replaced. Unknown ids decode to nothing.
"""

from __future__ import annotations

import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirloom.llm.common import Prints, kept, slices

N_BEST = 4
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1_500_000
_NEVER = "￿"  # stands for a U+2581 of the text; a noncharacter that is itself unknown

Segmentation = tuple[float, list[int]]


class Pieces:
    """A vocabulary: (piece, score, kind) by id; kinds: n normal, b byte, else control or unknown."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == "n"}
        self.scores = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == "b"}
        self.longest = max(map(len, self.ids), default=1)
        usual = [s for p, s, k in pieces if k == "n" and s > -1e8]
        self.unknown = min(usual, default=0.0) - UNKNOWN_PENALTY
        for p in self.ids:
            if SPACE in p.lstrip(SPACE) or "\n" in p and p != "\n":
                raise ValueError(f"the piece {p!r} crosses words")
        self.plain = [p.replace(SPACE, " ") if k == "n" else "" for p, _, k in pieces]
        self.special = set(self.bytes.values())
        self.heads: dict[str, int] = {}  # every beginning of a piece: its id if it is one, else -1
        for p in self.ids:
            for n in range(1, len(p)):
                self.heads.setdefault(p[:n], -1)
        self.heads.update(self.ids)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "b" if model.is_byte(i) else "c" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "n"
        return cls([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])

    def edges(self, word: str) -> list[tuple[int, int, float, int]]:
        """(start, end, score, id) of all edges, by start; the id of an unknown character is -1."""
        text = word.replace(SPACE, _NEVER).replace(" ", SPACE)
        n, get, scores = len(text), self.heads.get, self.scores
        out: list[tuple[int, int, float, int]] = []
        for i in range(n):
            piece = get(text[i])
            if piece is None or piece < 0:
                out.append((i, i + 1, self.unknown, -1))
                if piece is None:
                    continue
            else:
                out.append((i, i + 1, scores[piece], piece))
            for j in range(i + 2, n + 1):
                piece = get(text[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    out.append((i, j, scores[piece], piece))
        return out

    def best(self, word: str) -> tuple[float, list[int], float]:
        """(score, ids, loss of the second best) by Viterbi in both directions; any other segmentation has an edge off the best path."""
        text = word.replace(SPACE, _NEVER).replace(" ", SPACE)
        n, get, scores, unknown = len(text), self.heads.get, self.scores, self.unknown
        ahead, start, piece_at = [-1e18] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        ahead[0] = 0.0
        edges: list[tuple[int, int, float]] = []
        add = edges.append
        for i in range(n):
            so_far = ahead[i]
            piece = get(text[i])
            j = i + 1
            if piece is None or piece < 0:
                score, own = unknown, -1 - i
            else:
                score, own = scores[piece], piece
            while True:
                if own is not None:
                    add((i, j, score))
                    if so_far + score > ahead[j]:
                        ahead[j], start[j], piece_at[j] = so_far + score, i, own
                if piece is None or j == n:
                    break
                j += 1
                piece = get(text[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    own, score = piece, scores[piece]
                else:
                    own = None
        behind = [-1e18] * (n + 1)
        behind[n] = 0.0
        for i, j, score in reversed(edges):
            v = score + behind[j]
            if v > behind[i]:
                behind[i] = v
        ids, at, follows = [], n, [-1] * (n + 1)
        while at:
            ids.append(piece_at[at])
            follows[start[at]] = at
            at = start[at]
        second = -np.inf
        for i, j, score in edges:
            if follows[i] != j:
                v = ahead[i] + score + behind[j]
                if v > second:
                    second = v
        return ahead[n], ids[::-1], ahead[n] - second

    def nbest(self, word: str, n: int = N_BEST) -> list[tuple[float, tuple[int, ...]]]:
        """Up to n segmentations of a word, best first, as (score, ids); -1 - k stands for unknown character k of the word."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(word) + 1)]
        for i, j, s, piece in self.edges(word):
            ends[j].append((i, s, piece))
        best = [0.0] * len(ends)
        for j in range(1, len(ends)):
            best[j] = max(best[i] + s for i, s, _ in ends[j])
        # agenda: (loss if completed at best, place, order of arrival, score from here to the end, (id, rest))
        out, arrived = [], 0
        agenda: list[tuple] = [(-best[-1], len(ends) - 1, 0, 0.0, None)]
        popped = [0] * len(ends)
        while agenda and len(out) < n:
            _, place, _, score, rest = heapq.heappop(agenda)
            if place == 0:
                ids = []
                while rest is not None:
                    ids.append(rest[0])
                    rest = rest[1]
                out.append((score, tuple(ids)))
                continue
            if popped[place] >= n:
                continue
            popped[place] += 1
            for i, s, piece in ends[place]:
                arrived += 1
                heapq.heappush(agenda, (-(best[i] + s + score), i, arrived, s + score, (piece if piece >= 0 else -1 - i, rest)))
        return out

    def spelled(self, word: str, ids: tuple[int, ...]) -> list[int]:
        """ids with unknown characters as the pieces of their bytes."""
        if min(ids, default=0) >= 0:
            return list(ids)
        out: list[int] = []
        for i in ids:
            out += [i] if i >= 0 else [self.bytes[b] for b in word[-1 - i].encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; byte pieces are joined as UTF-8."""
        if self.special.isdisjoint(ids) and (not ids or 0 <= min(ids) and max(ids) < len(self.plain)):
            text = "".join([self.plain[i] for i in ids])
            return text[1:] if text.startswith(" ") else text
        parts: list[bytes] = []
        for i in ids:
            piece, _, kind = self.pieces[i] if 0 <= i < len(self.pieces) else ("", 0, "c")
            if kind == "b":
                parts.append(bytes([int(piece[3:5], 16)]))
            elif kind == "n":
                parts.append(piece.replace(SPACE, " ").encode())
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the parts that no piece crosses, in texts that begin with the space put before them: a run of spaces with what follows, or a line break."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space, line = data == 32, data == 10
    start = line.copy()
    start[1:] |= space[1:] & ~space[:-1]
    start[1:] |= ~space[1:] & line[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(start)
    return at, np.append(at[1:], len(data))


def combined(gaps: list[list[float]], n: int = N_BEST) -> list[float]:
    """The n smallest total losses over independent choices; gaps[w] are the losses of word w's further choices, rising."""
    totals = [0.0]
    for own in gaps:
        totals = heapq.nsmallest(n, (a + b for a, b in itertools.product(totals, [0.0, *own])))
    return totals


class Encoder:
    """Pieces with the results of words seen so far, in arrays sorted by the words' fingerprints: some 50 bytes a word."""

    def __init__(self, pieces: Pieces, n: int = N_BEST):
        self.pieces, self.n = pieces, n
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot, self.score, self.gap, self.size = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.losses: dict[bytes, list[float]] = {}

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Adds words by their fingerprints, none of which is known."""
        if len(self.keys) + len(words) > CACHE_WORDS:
            self.clear()
        score, gap, size, flat, at = array("d"), array("d"), array("q"), array("i"), len(self.flat)
        for word in words:
            top, ids, loss = self.pieces.best(word)
            own = self.pieces.spelled(word, tuple(ids))
            score.append(top)
            gap.append(loss)
            size.append(len(own))
            flat.extend(own)
        size = np.array(size, np.int64)
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every)
        self.keys = every[order]
        self.slot = np.concatenate([self.slot, at + np.cumsum(size) - size])[order]
        self.score = np.concatenate([self.score, np.array(score)])[order]
        self.gap = np.concatenate([self.gap, np.array(gap)])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])

    def further(self, word: bytes) -> list[float]:
        """The losses of a word's second to n-th best, by A*."""
        if word not in self.losses:
            found = self.pieces.nbest(word.decode(), self.n)
            if len(self.losses) >= CACHE_WORDS // 10:
                self.losses.clear()
            self.losses[word] = [found[0][0] - s for s, _ in found[1:]]
        return self.losses[word]

    def encode(self, texts: list[str | None]) -> list[tuple[list[float], np.ndarray]]:
        """(scores of the n best, best first; ids of the best) of each text; a null text has neither."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        whole = b"".join(raw)
        data, offsets = np.frombuffer(whole, np.uint8), np.cumsum([0, *map(len, raw)])
        start, end = words_of(data, offsets)
        keys, first, where = np.unique(Prints(data, False).of(start, end), return_index=True, return_inverse=True)
        near = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((near == len(self.keys)) | (self.keys[np.minimum(near, max(0, len(self.keys) - 1))] != keys) if len(self.keys) else np.ones(len(keys), bool))
        if len(new):
            if len(self.keys) + len(new) > CACHE_WORDS:
                self.clear()
                new = np.arange(len(keys))
            self.learn(keys[new], [whole[start[i] : end[i]].decode() for i in first[new].tolist()])
        k = np.searchsorted(self.keys, keys)[where]
        score, gap, size = self.score[k], self.gap[k], self.size[k]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.slot[k] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        sums, total = np.concatenate([[0.0], np.cumsum(score)]), np.concatenate([[0], ends])
        edge = np.searchsorted(start, offsets)  # each text's first word
        out = []
        for text, a, b in zip(texts, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            losses = [0.0]
            if self.n > 1 and b > a:
                few = a + (np.argpartition(gap[a:b], self.n - 2)[: self.n - 1] if b - a >= self.n else np.arange(b - a))
                losses = combined([self.further(whole[start[i] : end[i]]) for i in few.tolist() if gap[i] < np.inf], self.n)
            top = float(sums[b] - sums[a])
            out.append(([top - x for x in losses] if text is not None else [], ids[total[a] : total[b]]))
        return out


    def segmentations(self, text: str | None) -> list[tuple[float, list[int]]]:
        """(score, ids) of a text's n best segmentations, best first; none of a null text."""
        if not text:
            return [] if text is None else [(0.0, [])]
        raw = b" " + text.encode()
        start, end = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        lists = {w: self.pieces.nbest(w.decode(), self.n) for w in set(words)}
        # choices other than a word's best, as (score lost, ((word, place in its list), ...))
        found: list[tuple[float, tuple]] = [(0.0, ())]
        for i, w in enumerate(words):
            own = [(lists[w][0][0] - s, ((i, k),) if k else ()) for k, (s, _) in enumerate(lists[w])]
            found = sorted(((a + b, c + d) for a, c in found for b, d in own), key=lambda x: x[0])[: self.n]
        top, out = sum(lists[w][0][0] for w in words), []
        for loss, choices in found:
            chosen = dict(choices)
            out.append((top - loss, [x for i, w in enumerate(words) for x in self.pieces.spelled(w.decode(), tuple(lists[w][chosen.get(i, 0)][1]))]))
        return out


def _encoder(shared: object, n: int) -> Encoder:
    """The worker's own encoder for a broadcast vocabulary: kept between tasks, where workers are reused."""
    encoders = kept("encoders")
    key = (shared._id if hasattr(shared, "_id") else id(shared), n)
    if key not in encoders:
        encoders.clear()
        encoders[key] = Encoder(shared.value, n)
    return encoders[key]


def broadcast(spark: SparkSession, path: str = MODEL):
    """The vocabulary, read on the driver; its size is that of the file."""
    return spark.sparkContext.broadcast(Pieces.load(path))


OWN = ("n_pieces", "ids", "nbest_scores")


def encode(docs: DataFrame, vocabulary, text: str = "text", n: int = N_BEST, verify: bool = False, keep: list[str] | None = None, every: bool = False) -> DataFrame:
    """The columns `keep` of docs (all unless given) with n_pieces, ids (of the best segmentation) and nbest_scores put in; vocabulary comes from broadcast().

    With verify, round_trip tells whether decoding the ids gives the text; with every, nbest_ids has the ids of all the segmentations that nbest_scores scores.
    """
    own = OWN + ("round_trip",) * verify + ("nbest_ids",) * every
    names = [c for c in keep or docs.columns if c.lower() not in own]
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("s_row"), docs[text].alias("s_text"))
    fields = [rows.schema["s_row"], T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("nbest_scores", T.ArrayType(T.DoubleType()))]
    out = T.StructType(fields + [T.StructField("round_trip", T.BooleanType())] * verify + [T.StructField("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType())))] * every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, n)
        for batch in batches:
            for part, _, _ in slices(batch, "s_text", 1 << 20):
                texts = part.column("s_text").to_pylist()
                found = encoder.encode(texts)
                null = pa.array([t is None for t in texts])
                sizes = np.array([len(ids) for _, ids in found], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *(i for _, i in found)])), mask=null)
                columns = [part.column("s_row"), pa.array(sizes), ids, pa.array([None if t is None else s for t, (s, _) in zip(texts, found, strict=True)], pa.list_(pa.float64()))]
                if verify:
                    columns.append(pa.array([t is None or encoder.pieces.decode(i.tolist()) == t for t, (_, i) in zip(texts, found, strict=True)]))
                if every:
                    columns.append(pa.array([None if t is None else [ids for _, ids in encoder.segmentations(t)] for t in texts], pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return rows.mapInArrow(run, out).select("s_row.*", *own)


def decode(rows: DataFrame, vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the text that the ids stand for, in the column `into`."""
    keep = [c for c in rows.columns if c.lower() != into.lower()]
    packed = rows.select(F.struct(*(rows[c] for c in keep)).alias("s_row"), rows[ids].alias("s_ids"))
    out = T.StructType([packed.schema["s_row"], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column("s_row"), pa.array([None if i is None else pieces.decode(i) for i in part.column("s_ids").to_pylist()], pa.string())], out.names)

    return packed.mapInArrow(run, out).select("s_row.*", into)
