"""Vector bin packing of tokenised examples into sequences.

A sequence has three limits: tokens, segments (pieces) and loss-bearing tokens.
Whole chunks of an example leave as sequences of their own; what remains waits
in a pool of bounded size in its task. A bin is filled by the dot-product rule:
of the pieces that fit all three limits, the one whose demand vector has the
largest dot product with what is left in the bin comes next. If none fits, a
piece is cut to fill the bin. At the end of a task a bin that can't be filled is
cut to powers of two, which need no padding.

Each task packs its own rows and all pieces of an example are in one task, so
nothing is shuffled and a lost task is simply run again. Sequence ids carry the
partition's number in their upper bits.

A null or empty text is its closing id alone. Repeated rows are packed one by
one. Ids of examples are carried along and never looked up.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from quizlens.llm.common import in_process, tidied

POOL = 2048         # pieces that wait in a task, so at most POOL * tokens ids
KEEP = 300_000      # tokenised words that a worker remembers, at least; twice as many at most


@dataclass
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None     # None: every token bears loss
    total: int                  # tokens of the whole example

    def demand(self):
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, n):
        tail = None if self.loss is None else self.loss[n:]
        head = None if self.loss is None else self.loss[:n]
        return (
            Piece(self.key, self.start, self.ids[:n], head, self.total),
            Piece(self.key, self.start + n, self.ids[n:], tail, self.total),
        )

    def within(self, tokens, loss):
        """The most leading tokens that stay within both limits."""
        n = min(tokens, len(self.ids))
        if self.loss is None:
            return min(n, loss)
        return int(np.searchsorted(np.cumsum(self.loss[:n]), loss, side="right"))


class Packer:
    """Packs a stream of examples; ``out`` receives (sequence, offset, piece)."""

    def __init__(self, limits, first_sequence, out):
        self.limits, self.sequence, self.out = limits, first_sequence, out
        self.pool, self.size = [], np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, piece):
        while len(piece.ids) >= self.limits.tokens or piece.demand()[2] > self.limits.loss:
            n = piece.within(self.limits.tokens, self.limits.loss)
            if n < self.limits.tokens:
                n = 1 << (max(n, 1).bit_length() - 1)
            head, piece = piece.cut(n)
            self._close([head])
        if len(piece.ids):
            self.pool.append(piece)
        if len(self.pool) >= POOL:
            self.drain(POOL // 2)

    def _close(self, bin_):
        offset = 0
        for piece in bin_:
            self.out(self.sequence, offset, piece)
            offset += len(piece.ids)
        self.sequence += 1

    def drain(self, leave=0):
        """Pack until at most ``leave`` pieces wait."""
        pieces = self.pool
        need = np.array([p.demand() for p in pieces], float).reshape(-1, 3)
        open_ = np.ones(len(pieces), bool)
        while open_.sum() > leave:
            bin_, room = [], self.size.copy()
            while room[0] >= 1 and room[1] >= 1:
                fits = open_ & (need <= room).all(1)
                if fits.any():
                    k = int(np.where(fits, (need / self.size) @ (room / self.size), -1.0).argmax())
                    bin_.append(pieces[k])
                    room -= need[k]
                    open_[k] = False
                    continue
                rest = np.flatnonzero(open_)
                rest = rest[need[rest, 0] > 0]
                cuts = [(pieces[k].within(int(room[0]), int(room[2])), k) for k in rest[:64]]
                n, k = max(cuts, default=(0, 0))
                if n < 1:
                    break
                head, pieces[k] = pieces[k].cut(n)
                bin_.append(head)
                room -= head.demand()
                need[k] = pieces[k].demand()
                open_[k] = len(pieces[k].ids) > 0
            total = sum(len(p.ids) for p in bin_)
            if total < self.limits.tokens:
                self._powers(bin_, total)
            else:
                self._close(bin_)
        self.pool = [p for p, o in zip(pieces, open_) if o]

    def _powers(self, bin_, total):
        """Close an unfilled bin as sequences of 2^k tokens, largest first."""
        while total:
            size, part = 1 << (total.bit_length() - 1), []
            left = size
            while left:
                piece = bin_.pop(0)
                if len(piece.ids) > left:
                    piece, rest = piece.cut(left)
                    bin_.insert(0, rest)
                part.append(piece)
                left -= len(piece.ids)
            self._close(part)
            total -= size


# fixed values: the tokenizer file's split pattern for characters of which lower case and normal form are their own
SIMPLE = re.compile(r"[\x20-\x7e\n\t\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\s0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Words(dict):
    """Ids of the tokenizer's words, as bytes of 32-bit numbers.

    A text of ASCII and Latin letters only is lower-cased and split here, and the tokenizer's
    model encodes each distinct word once. Any other text goes through the whole tokenizer.
    """

    def __init__(self, path):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}

    def __missing__(self, word):
        ids = [token.id for token in self.model.tokenize(word.translate(self.shown))]
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found

    def ids(self, text):
        if len(self) > 2 * KEEP:
            for word in list(self)[KEEP:]:
                del self[word]
        if "<|" not in text and SIMPLE.fullmatch(text):
            return b"".join(map(self.__getitem__, SPLIT.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def _stream(df, work, schema):
    """Like ``by_batch``, with a last call that flushes what waits in the task."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches):
        arrow = to_arrow_schema(target)
        step = work()
        for batch in batches:
            # short slices: what leaves a batch is written before more is read
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(rows, schema=arrow)
        yield pa.RecordBatch.from_pydict(step(None), schema=arrow)

    return df.mapInArrow(tidied(run), target)


def _collector(limits, with_ids):
    from pyspark import TaskContext

    names = [part.split()[0] for part in PIECES.split(", ")] + (["ids"] if with_ids else [])
    rows = {name: [] for name in names}

    def out(sequence, offset, piece):
        raw = piece.ids.astype("<u4", copy=False).tobytes()
        values = (piece.key, piece.start, len(piece.ids), zlib.crc32(raw), piece.total, sequence, offset)
        for name, value in zip(names, values):
            rows[name].append(value)
        if with_ids:
            rows["ids"].append(piece.ids.astype("<i4"))

    def taken():
        nonlocal rows
        full, empty = rows, {name: [] for name in names}
        rows = empty
        return full

    return Packer(limits, TaskContext.get().partitionId() << 32, out), taken


def pack_texts(documents: DataFrame, tokenizer_path: str, limits=Limits(), closing_id=1) -> DataFrame:
    """Tokenise and pack whole texts; every token bears loss. One row per piece (``PIECES``)."""
    def work():
        words = in_process("packing_words", tokenizer_path, lambda: Words(tokenizer_path))
        packer, taken = _collector(limits, with_ids=False)
        tail = np.array([closing_id], "<u4").tobytes()

        def step(rows):
            if rows is None:
                packer.drain()
                return taken()
            for key, text in zip(rows["doc_id"], rows["text"]):
                ids = np.frombuffer(words.ids(text or "") + tail, "<u4")
                packer.add(Piece(key, 0, ids, None, len(ids)))
            return taken()

        return step

    return _stream(documents.select("doc_id", "text"), work, PIECES)


def pack(examples: DataFrame, limits=Limits()) -> DataFrame:
    """Pack ``doc_id, ids array<int>, loss array<boolean>`` (null: all bear loss); pieces come with their ids."""
    def work():
        packer, taken = _collector(limits, with_ids=True)

        def step(rows):
            if rows is None:
                packer.drain()
                return taken()
            for key, ids, loss in zip(rows["doc_id"], rows["ids"], rows["loss"]):
                ids = np.array(ids or [], "<u4")
                packer.add(Piece(key, 0, ids, None if loss is None else np.array(loss, bool), len(ids)))
            return taken()

        return step

    return _stream(examples.select("doc_id", "ids", "loss"), work, PIECES + ", ids array<int>")
