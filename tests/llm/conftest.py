import public_tokenizers
import pytest

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use inside, to see that they do not clash
    "id long, n_words int, kept string, part int, shard string, word string, spans string, label double, features string"
)
LONG = " ".join(f"word{i % 977} of the long text {i}" for i in range(6000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, LONG), (6, "x" * 70_000), (7, "the same words of a text twice"),
    (7, "the same words of a text twice"), (8, "the same words of a text twice"), (None, "no id but the words of a text"),
    (9, "12345 --- !!!"), (10, "naïve Çà et là — «œuvre» 日本語 𓀀 \u0301\u200b"), (11, None), (11, "another text under one id"),
]


@pytest.fixture
def frame(spark):
    def make(rows, langs=None):
        langs = langs or {}
        full = [
            (i, t, langs.get(i), None if i == 3 else "src0", None if t is None else len(t), 1, 2, "k", 3, "s", "w", "sp", 0.5, "f")
            for i, t in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd(frame):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    return frame(ODD)


@pytest.fixture
def empty(frame):
    return frame([])
