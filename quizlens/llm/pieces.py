"""Exact merge-type encoding with a piece vocabulary, and its decoding.

The library's result is what repeated merging of the best adjacent pair gives.
It is found without merging the whole text: all pieces in a segment come from
one Aho-Corasick pass; the longest piece at a position is taken if it is
compatible with the piece before it, else the next shorter one; if none is
left, the position is marked as failed in a bit field and the last piece is
taken back. Two pieces are compatible if merging their joined text gives just
these two again; that is checked by merging and remembered.

A word mark occurs in pieces only at the start or in runs of marks, so texts
are cut before each word, and a worker encodes a distinct segment once.
Characters outside the vocabulary become their bytes. A null text is the empty
text, whose only id is the end id.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import by_batch, in_process, opened, sent

MARK = "▁"
KEEP = 300_000      # encoded segments that a worker remembers, at least; twice as many at most
RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
ENDED = -1


class Pieces:
    """The vocabulary of a model file: merge order, byte pieces and texts.

    Built once on the driver and sent to the tasks, which only set up the automaton.
    """

    def __init__(self, path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte = {int(text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        bytes_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.end = model.eos_id()
        self.raw = [b"" if i in special else bytes_of.get(i, text[i].encode()) for i in range(size)]
        self.text = text
        self.id = {text[i]: i for i in range(size) if i not in special and i not in bytes_of}
        self.rank = {piece: -model.get_score(i) for piece, i in self.id.items()}
        self.halves = {}    # piece -> the two pieces that its last merge joins
        # a piece that merging can't build never shows up in an encoding
        self.whole = [p for p in self.id if len(p) == 1 or self.merged(p) == [p]]
        known = set(self.whole)
        self.shorter = {
            self.id[p]: next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), ENDED)
            for p in self.whole
        }
        self.length = [len(t) for t in text]
        self.pairs = {}
        # neighbours that some piece holds; between any others no merge takes place
        self.neighbours = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        self.line_ends = any("\n" in p for p in self.id)

    def ready(self):
        """Set up the automaton, which stays in its task."""
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece in self.whole:
            self.find.add_word(piece, (len(piece), self.id[piece]))
        self.find.make_automaton()
        return self

    def merged(self, text):
        """Repeated merging of the adjacent pair with the best score, the leftmost among equals."""
        import heapq

        parts, rank = list(text), self.rank
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < len(parts):
                joined = parts[i] + parts[j]
                if joined in rank:
                    heapq.heappush(heap, (rank[joined], i, j, joined))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != joined:
                continue
            if joined not in self.halves and len(joined) <= len(text):
                self.halves[joined] = parts[i], parts[j]
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def fits(self, left, right):
        """Whether the two pieces stay as they are when their joined text is merged.

        Merging is replayed backwards at the border: of the two pieces that touch it, the one
        merged last is taken apart, and between two such steps the pair at the border must not
        be a piece whose turn would have come before the step.
        """
        rank, halves = self.rank, self.halves
        a, b = self.text[left], self.text[right]
        turn, ties = float("inf"), False
        while True:
            joined = rank.get(a + b)
            if joined is not None and (joined < turn or ties and joined == turn):
                return False
            one, two = halves.get(a), halves.get(b)
            if two and (not one or rank[b] >= rank[a]):
                turn, ties, b = rank[b], True, two[0]       # the border lies left of this merge
            elif one:
                turn, ties, a = rank[a], False, one[1]
            else:
                return True
            if len(a) > 1 and rank[a] > turn or len(b) > 1 and rank[b] > turn:   # not merged in the order of ranks
                return self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]

    def segment(self, text):
        """The ids of a segment."""
        longest = {}
        for last, (n, piece) in self.find.iter(text):
            longest[last - n + 1] = piece
        if len(longest) == len(text):
            return self._chain(0, len(text), longest)
        out, at = [], 0
        while at < len(text):
            stop = at
            while stop in longest:
                stop += 1
            if stop > at:
                out += self._chain(at, stop, longest)
                at = stop
            else:
                out += [self.byte[b] for b in text[at].encode()]
                at += 1
        return out

    def _chain(self, start, stop, longest):
        """Backtracking from ``start`` to ``stop``, where each single character is a piece."""
        shorter, length, pairs = self.shorter, self.length, self.pairs
        taken, at, piece, last = [], start, longest[start], None
        failed = 0                  # bit field of positions from which no way leads on
        while True:
            while piece != ENDED:
                end = at + length[piece]
                if not failed or not failed >> (end - start) & 1:
                    if last is None:
                        break
                    good = pairs.get((last, piece))
                    if good is None:
                        if len(pairs) > 500_000:
                            pairs.clear()
                        good = pairs[last, piece] = self.fits(last, piece)
                    if good:
                        break
                piece = shorter[piece]
            else:
                failed |= 1 << (at - start)
                piece = shorter[taken.pop()]
                at -= length[last]
                last = taken[-1] if taken else None
                continue
            taken.append(piece)
            if end == stop:
                return taken
            at, last, piece = end, piece, longest[end]

    def decode(self, ids):
        """The text of ids: the dummy space in front goes, marks become spaces, bytes join."""
        raw = b"".join(map(self.raw.__getitem__, ids)).replace(MARK.encode(), b" ")
        return raw.removeprefix(b" ").decode("utf-8", "replace")


class Encoder(dict):
    """Remembers the ids of segments, as bytes of 32-bit numbers."""

    def __init__(self, pieces):
        super().__init__()
        self.pieces = pieces
        self.inner = {}     # what follows a line end inside a segment

    def __missing__(self, word):
        near = self.pieces.neighbours
        if "\n" in word and word[0] != "\n" and not self.pieces.line_ends:
            head, _, tail = word.partition("\n")
            if len(self.inner) > KEEP:
                self.inner.clear()
            if tail not in self.inner:
                self.inner[tail] = np.array(self.pieces.segment("\n" + tail), "<i4").tobytes()
            return self[head] + self.inner[tail]
        cut = len(word)     # no merge takes place between the signs after it, nor with what is before it
        while cut > 1 and not word[cut - 1].isalnum() and word[cut - 2:cut] not in near:
            cut -= 1
        if cut < len(word):
            ids = self[word[:cut]] + np.array(self.pieces.segment(word[cut:]), "<i4").tobytes()
        else:
            ids = np.array(self.pieces.segment(MARK + word), "<i4").tobytes()
        self[word] = ids
        return ids

    def encode(self, text):
        if text.startswith(" ") or "  " in text or MARK in text:
            runs = RUNS.findall(MARK + text.replace(" ", MARK))
            ids = b"".join(
                self[run[1:]] if run[:2] != MARK * 2 and run[0] == MARK else np.array(self.pieces.segment(run), "<i4").tobytes()
                for run in runs
            )
        elif text:
            ids = b"".join(map(self.__getitem__, text.split(" ")))
        else:
            ids = b""
        if len(self) > 2 * KEEP:  # the first ones seen are the frequent ones
            for word in list(self)[KEEP:]:
                del self[word]
        return ids


def encode(documents: DataFrame, model_path: str, end=True) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row of ``doc_id`` and ``text``."""
    shared = sent(documents.sparkSession, Pieces(model_path))

    def work():
        encoder = in_process("pieces", model_path, lambda: Encoder(opened(shared).ready()))
        tail = np.array([encoder.pieces.end], "<i4").tobytes() if end else b""

        def step(rows):
            parts = [encoder.encode(text or "") + tail for text in rows["text"]]
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            return {
                "doc_id": rows["doc_id"],
                "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
            }

        return step

    return by_batch(documents.select("doc_id", "text"), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` rows as ``doc_id, ids, decoded``; special ids have no text."""
    shared = sent(encoded.sparkSession, Pieces(model_path))

    def work():
        pieces = opened(shared)
        return lambda rows: {**rows, "decoded": [pieces.decode(ids or ()) for ids in rows["ids"]]}

    return by_batch(encoded.select("doc_id", "ids"), work, "doc_id long, ids array<int>, decoded string")


def round_trip(documents: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded``: both steps in one pass over the texts."""
    shared = sent(documents.sparkSession, Pieces(model_path))

    def work():
        encoder = in_process("pieces", model_path, lambda: Encoder(opened(shared).ready()))
        pieces = encoder.pieces
        tail = np.array([pieces.end], "<i4")

        def step(rows):
            arrays = [np.concatenate([np.frombuffer(encoder.encode(t or ""), "<i4"), tail]) for t in rows["text"]]
            offsets = np.cumsum([0, *map(len, arrays)])
            return {
                "doc_id": rows["doc_id"],
                "ids": pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays))
                ),
                "decoded": [pieces.decode(a.tolist()) for a in arrays],
            }

        return step

    return by_batch(documents.select("doc_id", "text"), work, "doc_id long, ids array<int>, decoded string")


def digests(done: DataFrame) -> DataFrame:
    """``n_tokens`` and the SHA-256 of the ids in decimal and of the decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
