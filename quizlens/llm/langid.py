"""Language identification with segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the
product of the piece probabilities; a forward pass gives that sum. A text's
score is the product over its words, and the languages' scores are normalised.

The pieces' probabilities come from expectation maximisation over the words of
a sample of labelled texts: ``per_language`` texts of each language at most.
Each round is a Spark job over the sample's distinct words.

A text that is null or has no letter is ``und`` with score 0, and so is every
text if no labelled text has a letter. Ties go to the first language in
alphabetical order. Labels that are null are not learned from.
"""

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import Numbering, bounded_sample, by_batch, cut_lineage, in_process, opened, sent, sliced, texts_of, tidied

RUN = 48            # letters; longer words are scored in runs of this many
SCALE = 30.0        # per letter, the same for all languages; keeps products of many factors away from zero
UNKNOWN = 1e-7      # probability of a letter that is no piece
KEEP = 250_000      # words whose scores a worker remembers, at least; twice as many at most
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list
    pieces: dict        # piece -> row
    weights: np.ndarray  # (rows, languages): probability times SCALE per letter
    key: str            # tells models apart


def words_of(text):
    """Runs of letters, lower-cased, each with the mark of a word's start."""
    found = LETTERS.findall(text.lower())
    if len(text) > RUN and max(map(len, found), default=0) >= RUN:
        found = [w[i:i + RUN - 1] for w in found for i in range(0, len(w), RUN - 1)]
    return found


def vocabulary(path):
    """Pieces that consist of letters, with or without the mark of a word's start, lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(p for p in found if LETTERS.fullmatch(p.removeprefix("▁")) and p == p.lower())


class Lattice:
    """All pieces in a batch of words: word, start, end and row of each, ordered by end."""

    def __init__(self, pieces):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, row in pieces.items():
            self.find.add_word(piece, (len(piece), row))
        self.find.make_automaton()
        self.unknown = len(pieces)

    def cut(self, words):
        word, start, end, row = [], [], [], []
        for k, text in enumerate(words):
            text = "▁" + text
            seen = [False] * len(text)
            for last, (n, r) in self.find.iter(text):
                word.append(k), start.append(last - n + 1), end.append(last + 1), row.append(r)
                seen[last] |= n == 1
            for i, known in enumerate(seen):
                if not known:
                    word.append(k), start.append(i), end.append(i + 1), row.append(self.unknown)
        arcs = np.array([word, start, end, row], dtype=np.int64).reshape(4, -1)
        return arcs[:, np.argsort(arcs[2], kind="stable")]


def forward(arcs, weights, n_words):
    """(words, positions, languages): the summed weight of all ways to reach each position."""
    word, start, end, row = arcs
    width = int(end.max(initial=0)) + 1
    alpha = np.zeros((n_words, width, weights.shape[1]))
    alpha[:, 0] = 1.0
    bounds = np.searchsorted(end, np.arange(width + 1))
    for at in range(1, width):
        part = slice(bounds[at], bounds[at + 1])
        np.add.at(alpha, (word[part], at), alpha[word[part], start[part]] * weights[row[part]])
    return alpha


def backward(arcs, weights, n_words, lengths, width):
    word, start, end, row = arcs
    beta = np.zeros((n_words, width, weights.shape[1]))
    beta[np.arange(n_words), lengths] = 1.0
    order = np.argsort(start, kind="stable")[::-1]
    word, start, end, row = word[order], start[order], end[order], row[order]
    bounds = np.searchsorted(-start, -np.arange(width), side="left")
    upto = np.searchsorted(-start, -np.arange(width), side="right")
    for at in range(width - 1, -1, -1):
        part = slice(bounds[at], upto[at])
        np.add.at(beta, (word[part], at), beta[word[part], end[part]] * weights[row[part]])
    return beta


def log_scores(words, lattice, weights):
    """(words, languages): log of each word's summed weight."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    alpha = forward(lattice.cut(words), weights, len(words))
    total = alpha[np.arange(len(words)), [len(w) + 1 for w in words]]
    return np.log(np.maximum(total, 1e-300))


def expected(words, counts, column, lattice, weights):
    """Expected uses of each row of ``weights`` in words, each seen ``counts`` times in language ``column``."""
    arcs = lattice.cut(words)
    own = weights[:, None, :]
    lengths = np.array([len(w) + 1 for w in words])
    alpha = forward(arcs, weights, len(words))
    beta = backward(arcs, weights, len(words), lengths, alpha.shape[1])
    word, start, end, row = arcs
    language = column[word]
    mass = alpha[word, start, language] * own[row, 0, language] * beta[word, end, language]
    total = alpha[word, lengths[word], language]
    uses = np.zeros(weights.shape)
    np.add.at(uses, (row, language), counts[word] * mass / np.maximum(total, 1e-300))
    return uses


def _weights(uses, lengths, prior=0.1):
    shares = (uses + prior) / (uses.sum(0) + prior * len(uses))
    shares[-1] = UNKNOWN
    return shares * (SCALE ** lengths)[:, None]


def train(labelled: DataFrame, documents: DataFrame, model_path: str, per_language=400, rounds=3) -> Model:
    """Learn from ``labelled`` (``doc_id``, ``lang``), whose texts are in ``documents``."""
    known = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    sample = texts_of(documents, bounded_sample(known, "doc_id", per_language, "lang"))

    def split():
        return lambda rows: _exploded(rows["lang"], rows["text"])

    words = cut_lineage(
        by_batch(sample.select("lang", "text"), split, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    languages = sorted(row[0] for row in words.select("lang").distinct().collect())
    names = vocabulary(model_path)
    pieces = {piece: i for i, piece in enumerate(names)}
    lengths = np.array([len(p) for p in names] + [1.0])
    uses = np.ones((len(names) + 1, len(languages)))
    for _ in range(rounds if languages else 0):
        weights = _weights(uses, lengths)

        def count(weights=weights):
            lattice = Lattice(pieces)

            def step(rows):
                column = np.array([languages.index(x) for x in rows["lang"]])
                total = np.zeros(weights.shape)
                for at in range(0, len(column), 2000):
                    part = slice(at, at + 2000)
                    total += expected(rows["word"][part], np.array(rows["n"][part], float), column[part], lattice, weights)
                row, language = np.nonzero(total)
                return {"piece": row.tolist(), "language": language.tolist(), "uses": total[row, language].tolist()}

            return step

        found = by_batch(words, count, "piece int, language int, uses double")
        uses = np.zeros(uses.shape)
        # at most vocabulary x languages rows; rounded so that the order of summing does not matter
        for piece, language, n in found.groupBy("piece", "language").agg(F.round(F.sum("uses"), 6)).collect():
            uses[piece, language] = n
    weights = _weights(uses, lengths)
    return Model(languages, pieces, weights, uuid.uuid4().hex)


def _exploded(languages, texts):
    from collections import Counter

    found = Counter()
    for language, text in zip(languages, texts):
        found.update((language, w) for w in words_of(text or ""))
    return {"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}


def scorer(shared, key):
    """The work of a task: gives the function that judges a list of texts, as (language, score) pairs."""
    def looked_up():
        learned = opened(shared)
        return {
            "learned": learned, "lattice": Lattice(learned.pieces), "memo": Numbering(),
            "table": np.zeros((0, len(learned.languages))),
        }

    kept = in_process("langid", key, looked_up)
    lattice, memo = kept["lattice"], kept["memo"]
    languages, weights = kept["learned"].languages, kept["learned"].weights

    def sums(texts):
        table = kept["table"]
        numbers = [np.fromiter(map(memo.__getitem__, words), np.int64) for words in map(words_of, texts)]
        fresh, memo.fresh = memo.fresh, []
        new = [log_scores(fresh[i:i + 4000], lattice, weights) for i in range(0, len(fresh), 4000)]
        size = len(memo)
        if size > len(table):
            table = np.concatenate([table, np.zeros((max(size, 2 * len(table)) - len(table), len(languages)))])
        if new:
            table[size - len(fresh):size] = np.concatenate(new)
        found = [table[n].sum(0) for n in numbers]
        if len(memo) > 2 * KEEP:
            memo.shrink(KEEP)
            table = table[:KEEP]
        kept["table"] = table
        return zip(map(len, numbers), found)

    def judge(texts):
        out = []
        for at in range(0, len(texts), 256):
            part = [text or "" for text in texts[at:at + 256]]
            for text, (n, total) in zip(part, sums(part)):
                if n and languages and any(map(str.isalpha, text)):
                    k = int(total.argmax())
                    out.append((languages[k], float(1.0 / np.exp(total - total[k]).sum())))
                else:
                    out.append(("und", 0.0))
        return out

    return judge


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; one map stage over whole texts."""
    shared, key = sent(documents.sparkSession, model), model.key     # vocabulary x languages numbers

    def work():
        judge = scorer(shared, key)

        def step(rows):
            found = judge(rows["text"])
            return {"doc_id": rows["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return step

    return by_batch(documents.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double")


def keep(documents: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, with their columns as they are."""
    shared, key = sent(documents.sparkSession, model), model.key
    at = documents.columns.index("text")

    def run(batches):
        judge = scorer(shared, key)
        for batch in sliced(batches):
            mask = [language != "und" and score >= least for language, score in judge(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return documents.mapInArrow(tidied(run), documents.schema)
