"""Plain-loop twins of what SQL can't express: I-Match fingerprints and their likeness, toxicity features and lexicons."""

import math
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quizlens.llm import fingerprints, toxicity

FOLDER = "/root/testdata/sf0.001"
WORDS_64 = 2**64


# 9 fingerprints

def plain_terms(text):
    found = set()
    for word in text.lower().split():
        while word and word[0] in ".,;:!?\"'()[]{}<>|*#$%&":
            word = word[1:]
        while word and word[-1] in ".,;:!?\"'()[]{}<>|*#$%&":
            word = word[:-1]
        if word:
            found.add(word)
    return found


def plain_lexicon(texts, low, high):
    counts = Counter(term for text in texts for term in plain_terms(text))
    return sorted(t for t, n in counts.items() if max(2.0, low * len(texts)) <= n <= max(2.0, high * len(texts)))


def is_drawn(term, subset):
    x = xxhash.xxh3_64_intdigest(term) ^ ((subset + 1) * 0x9E3779B97F4A7C15 % WORDS_64)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % WORDS_64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % WORDS_64
    return float(x ^ (x >> 31)) / 2.0**64 < 0.5 ** (1 + subset // fingerprints.PER_LEVEL)


def plain_marks(text, words):
    known = sorted(plain_terms(text) & words)
    marks = []
    for subset in range(fingerprints.LEVELS * fingerprints.PER_LEVEL):
        chosen = [t for t in known if is_drawn(t, subset)]
        raw = b"".join(struct.pack("<Q", xxhash.xxh3_64_intdigest(t)) for t in chosen)
        marks.append((xxhash.xxh3_64_intdigest(raw) % 2**32 or 1) if chosen else 0)
    return marks


def plain_print(text, marks):
    if not any(marks):
        return "-" + xxhash.xxh3_128_hexdigest(text)
    return ",".join("-" if m == 0 else f"{m:x}" for m in marks)


def plain_likeness(a, b):
    levels = []
    for level in range(fingerprints.LEVELS):
        pairs = [(a[s], b[s]) for s in range(level * fingerprints.PER_LEVEL, (level + 1) * fingerprints.PER_LEVEL)]
        used = [p for p in pairs if p != (0, 0)]
        levels.append((len(used), sum(x == y for x, y in used)))
    enough = max(1, min(4, max(n for n, _ in levels)))
    return max((same / n for n, same in levels if n >= enough), default=0.0)


def test_fingerprints_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 4 = 1 OR doc_id < 12")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), reverse=True)
    texts = [t for _, t in rows]
    words = plain_lexicon(texts, 0.05, 0.5)
    assert fingerprints.lexicon(docs, 0.05, 0.5) == words and len(words) > 50
    known = set(words)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, words).collect()}
    for k, (doc_id, text) in enumerate(rows):
        after = texts[(k + 1) % len(texts)]
        third = len(text) // 3
        changed = text[:len(text) - third] + after[:third]
        own, new, following = (plain_marks(t, known) for t in (text, changed, after))
        a, b, c = plain_print(text, own), plain_print(changed, new), plain_print(after, following)
        r = got[doc_id]
        assert (r["n_chars"], r["edited_text"], r["fingerprint"], r["edited_fingerprint"]) == (len(text), changed, a, b)
        assert r["near_edited"] == pytest.approx(1.0 if a == b else plain_likeness(own, new))
        assert r["near_next"] == pytest.approx(1.0 if a == c else plain_likeness(own, following))


# 5 toxicity

def plain_words(text):
    return re.split(r"[\s.,;:!?\"()\[\]]+", text.lower())


def plain_gain(word, lexicon):
    known = [lexicon[e] for e in [word] + [word[:n] + "~" for n in (4, 5, 6, 7) if len(word) > n] if e in lexicon]
    return max(known, default=0.0)


def plain_features(text, lexicon):
    words = [w for w in plain_words(text) if w]
    if not words:
        return [0.0] * 14
    n = len(words)
    gains = [plain_gain(w, lexicon) for w in words]
    listed = [w in toxicity.INSULTS for w in words]
    addressed = [w in toxicity.YOU for w in words]
    near = sum(1 for i in range(n) if (gains[i] or listed[i]) and any(addressed[max(0, i - 5):i + 6]))
    hidden, uncovered = 0, 0
    for i, word in enumerate(words):
        if word.isalpha() or not any(c.isalpha() for c in word):
            continue
        letters = "".join(c for c in word.translate(toxicity.PLAIN) if re.fullmatch(r"[^\W\d_]", c))
        if not letters:
            continue
        hidden += bool(re.search(r"[^\W\d_][*@$!#0134578|+._-]+[^\W\d_]", word))
        inner = word.strip("*")
        masked = "*" in inner and any(
            len(i) == len(inner) and all(a == "*" or a == b for a, b in zip(inner, i)) for i in toxicity.INSULTS
        )
        uncovered += letters in toxicity.INSULTS or letters in lexicon or masked
    marks = sum(c in "!?" for c in text)
    capitals = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ" for c in text)
    shouts = sum(len(w) > 2 and w.isupper() for w in text.split()) if 2 * capitals > n else 0
    return [
        sum(g != 0 for g in gains) / n, len({w for w, g in zip(words, gains) if g}),
        sum({w: g for w, g in zip(words, gains) if g}.values()), sum(listed) / n, len({w for w, x in zip(words, listed) if x}),
        near / n, sum(addressed) / n, capitals / len(text), shouts / n, marks / n,
        len(re.findall(r"[!?][!?]+", text)) if marks > 1 else 0, hidden / n, uncovered, math.log(1 + n),
    ]


PLANTED = [
    "", " \n", "You are an IDIOT!!! you m0r0n", "1d10t st*pid l0ser, tr@sh", "a 12345 *** --- ?!", "ÉCRIT ÀÇÖ Þing YOU YOU",
    "nothing to see here. at all", "pathetic~ pathetically you stupid? no", "*idiot* i*iot s.t.u.p.i.d",
]


def test_features_against_a_plain_loop(spark):
    lexicon = {"pathe~": 4.0, "loser": 3.5, "garten~": 3.2, "house": 3.1, "trash": 5.0}
    texts = PLANTED + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    judge = toxicity.Judge(lexicon)
    for text in texts:
        assert judge.features(text) == pytest.approx(plain_features(text, lexicon)), text[:80]


def test_lexicons_against_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MIN_GAIN", 0.7)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    sample = docs.join(labels, "doc_id").select(
        "text", F.col("toxic").cast("int").alias("toxic"), (F.col("doc_id") % toxicity.PARTS).cast("int").alias("part")
    )
    rows = [tuple(r) for r in sample.collect()]
    got = toxicity.learn_lexicons(sample)
    for left_out in (None, *range(toxicity.PARTS)):
        used = [(text, toxic) for text, toxic, part in rows if part != left_out]
        held = {0: Counter(), 1: Counter()}
        for text, toxic in used:
            words = {w for w in plain_words(text) if w}
            held[toxic].update({e for w in words for e in [w] + [w[:n] + "~" for n in (4, 5, 6, 7) if len(w) > n]})
        totals = [sum(toxic == t for _, toxic in used) for t in (0, 1)]
        expected = {}
        for entry, bad in held[1].items():
            odds = [(held[t][entry] + 0.5) / (totals[t] + 1.0) for t in (0, 1)]
            if bad >= toxicity.MIN_TEXTS and math.log(odds[1]) - math.log(odds[0]) >= toxicity.MIN_GAIN:
                expected[entry] = math.log(odds[1]) - math.log(odds[0])
        assert 0 < len(expected) < toxicity.LEXICON
        assert got[left_out] == pytest.approx(expected)
