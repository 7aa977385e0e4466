"""Mixing, Merkle manifest and phrase mining against plain loops, on odd, hot and empty tables."""

import hashlib
import re
import string
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizlens.llm import common, merkle, mixing, phrases
from tests.llm.conftest import LONG, ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# helpers

def test_running_total_of_hot_keys(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, i % 5) for i in range(3000)]
    out = common.running_total(spark.createDataFrame(rows, "k string, at int, w int"), ["k"], ["at"], "w").collect()
    sums = Counter()
    expected = []
    for k, at, w in sorted(rows, key=lambda r: r[1]):
        expected.append((k, at, sums[k]))
        sums[k] += w
    assert sorted((r["k"], r["at"], r["_before"]) for r in out) == sorted(expected)


def test_expand_in_stretches(spark):
    rows = spark.createDataFrame([("a", 25), ("b", 1), ("c", 0)], "name string, n long")
    out = Counter((r["name"], r["_k"]) for r in common.expand(rows, "n", ["name"], most=4).collect())
    assert out == Counter([("a", k) for k in range(25)] + [("b", 0)])


# 11 mixing

def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    whole, limited = sum(sizes.values()), set()
    while True:
        rest = whole - sum(3 * sizes[s] for s in limited)
        open_ = sum(weight[s] for s in sizes if s not in limited)
        aimed = {s: Fraction(3 * sizes[s]) if s in limited else Fraction(weight[s] * rest, max(open_, 1)) for s in sizes}
        over = {s for s in sizes if aimed[s] > 3 * sizes[s]}
        if not over:
            return aimed
        limited |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 3000, None: 5}, {"x": 7}, {"a": 1, "b": 1, "c": 1, "d": 10**6}, {"a": 0, "b": 40},
    {f"s{k}": 3**k for k in range(12)}, {"é": 50, "z": 400, "Z": 900, "": 30},
])
def test_targets_are_filled_by_weight(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    assert got == {s: float(t) for s, t in plain_targets(sizes).items()}
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.fixture
def sourced(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), "w " * int(n), "hot" if i % 3 == 0 else f"s{i % 5}" if i % 11 else None)
            for i, n in enumerate(rng.integers(0, 60, 900))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


def test_taken_words_come_near_the_targets(sourced):
    rows, docs = sourced
    got = mixing.draw(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= 60
    again = mixing.draw(docs.repartition(3).select("doc_id", "text", "source")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_stretches_against_a_plain_sum(sourced):
    rows, docs = sourced
    sizes, held = Counter(), defaultdict(list)
    for i, text, source in rows:
        n = len(WORD.findall(text))
        sizes[source] += n
        h = hashlib.md5("\x1f".join((str(i), text, source or "-")).encode()).hexdigest()
        held[source].append((n if h < "8" else mixing.LONGEST - n, h, i))
    expected = {}
    aimed = plain_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = sum((5, 2, 1)[k % 3] for k, s in enumerate(order) if aimed[s] != 3 * sizes[s])
    for source, target in aimed.items():
        rate = target / sizes[source]
        drawn = int(hashlib.md5(("mix" + ("" if source is None else "=" + source)).encode()).hexdigest()[:15], 16)
        limit = target == 3 * sizes[source]
        den = 1 if limit else sizes[source] * weights
        at = Fraction(drawn % den, den)
        for _, _, i in sorted(held[source]):
            expected[i] = int(at + rate) - int(at)
            at += rate
    assert {r["doc_id"]: r["copies"] for r in mixing.draw(docs).collect()} == expected


def test_mix_gives_out_whole_rows(frame):
    docs = frame([(i, f"text {i} of some words " * (1 + i % 9)) for i in range(60)] + [(7, "the same row")] * 40)
    copies = Counter()
    for r in mixing.draw(docs).collect():
        copies[r["doc_id"], r["size"]] += r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter((r["doc_id"], len(WORD.findall(r["text"]))) for r in mixed.collect())
    assert got == +copies


def test_mix_of_odd_and_empty_tables(odd, empty):
    rows = mixing.draw(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD)
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(t or "")) for _, t in ODD)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.draw(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_rows_of_one_id_take_one_stretch(spark):
    rows = [(None, f"word {i % 40} " * 3, "a") for i in range(400)] + [(i, "x y z", "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.draw(docs).collect()
    taken = sum(r["taken"] for r in got if r["source"] == "a")
    assert len(got) == 600 and abs(taken - got[0]["target"] if got[0]["source"] == "a" else 0) <= 2400


# 12 Merkle manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, **other):
    values = {c: other.get(c, row[c]) for c in COLUMNS}
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values.values()))


def plain_tree(nodes, arity):
    paths, held = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for first in range(0, len(nodes), arity):
            run = nodes[first:first + arity]
            for k in range(len(run)):
                for i in held[first + k]:
                    paths[i] += ["".join(run[:k]), "".join(run[k + 1:])]
            above.append(H(*run))
            members.append(sum(held[first:first + arity], []))
        nodes, held = above, members
    return nodes[0], paths


def plain_proofs(rows, arity=8):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, out = {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        subroots[g], groups[g, "paths"] = plain_tree([plain_leaf(r) for r in groups[g]], arity)
    root, tops = plain_tree([subroots[g] for g in names], arity)
    for g, top in zip(names, tops):
        for place, (r, path) in enumerate(zip(groups[g], groups[g, "paths"])):
            out.append((r["doc_id"], g, place, plain_leaf(r), subroots[g], root, tuple(path + top)))
    return sorted(out, key=repr)


def proven(rows):
    names = ("doc_id", "lang", "position", "leaf", "subroot", "root")
    return sorted(((*(r[n] for n in names), tuple(r["proof"])) for r in rows), key=repr)


def test_proofs_of_odd_tables(odd):
    got = merkle.prove(odd, COLUMNS, "lang", "doc_id").collect()
    assert proven(got) == plain_proofs(odd.collect())
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)


def test_no_proofs_of_nothing(empty):
    assert merkle.prove(empty, COLUMNS, "lang", "doc_id").count() == 0


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65, 700])
def test_superblocks_of_several_tiers(frame, monkeypatch, count):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    langs = {i: (None, "en", "de", "é", "zh")[min(i % 7, 4)] for i in range(count)}
    docs = frame([(i, f"Text {i}") for i in range(count)], langs).repartition(5)
    assert proven(merkle.prove(docs, COLUMNS, "lang", "doc_id").collect()) == plain_proofs(docs.collect())


def test_many_groups_make_a_deep_top(frame, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    docs = frame([(i, f"text {i}") for i in range(150)], {i: f"l{i % 75}" for i in range(150)})
    assert proven(merkle.prove(docs, COLUMNS, "lang", "doc_id").collect()) == plain_proofs(docs.collect())


def test_equal_rows_get_neighbouring_places(frame):
    docs = frame([(7, "the same row")] * 90 + [(i, f"text {i}") for i in range(20)] + [(None, "no id")] * 30).repartition(5)
    assert proven(merkle.prove(docs, COLUMNS, "lang", "doc_id").collect()) == plain_proofs(docs.collect())


def test_tampered_rows_do_not_verify(frame):
    docs = frame([(i, f"TEXT {i}" if i % 2 else f"text {i}") for i in range(200)], {i: "en" for i in range(100)})
    changed = {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    got = {r["doc_id"]: r for r in merkle.prove(docs, COLUMNS, "lang", "doc_id", changed).collect()}
    for row in docs.collect():
        r = got[row["doc_id"]]
        folded = plain_leaf(row, text=row["text"].translate(LOW))
        for k in range(0, len(r["proof"]), 2):
            folded = H(r["proof"][k], folded, r["proof"][k + 1])
        assert r["folded_root"] == folded and r["verified"] == (row["doc_id"] % 2 == 0)


# 13 phrases

def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW))]


def plain_counts(rows, longest):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for words in pieces_of(text):
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    return counts, total


def plain_phrases(rows, longest=3, least=10, share=50, most=2000):
    counts, total = plain_counts(rows, longest)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {
            p[i:i + n] for p, a in candidates.items() for n in range(2, len(p)) for i in range(len(p) - n + 1)
            if 100 * a >= share * f[p[i:i + n]]
        }
        ranked = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score))
        out += [(lang, i, *row[3:]) for i, row in enumerate(sorted(ranked)[:most], 1)]
    return sorted(out)


def mined(docs, most=2000, **options):
    rows = phrases.ranked(phrases.collocations(docs, **options), most).collect()
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows)


def babble(n, words, seed=1):
    rng = np.random.default_rng(seed)
    signs = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]
    return ["".join(f"{'Wv'[k % 2]}{k}" + signs[s] for k, s in zip(rng.zipf(1.6, words) % 30, rng.integers(0, 9, words)))
            for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_index_counts_all_phrases(longest):
    text = babble(1, 800)[0]
    names, ids = common.Numbering(), []
    names[phrases.CUT]
    for words in phrases.slabs(text.encode(), phrases._byte_table()):
        ids += [names[w] for w in [*words, phrases.CUT]]
    known = [w.decode("latin-1") for w in names]
    got = {tuple(known[k] for k in row): int(c) for rows, counts in phrases.ngrams(np.array(ids), longest)
           for row, c in zip(rows.tolist(), counts)}
    assert got == dict(plain_counts([("x", text)], longest)[0]["x"])


def test_slabs_lose_no_word(monkeypatch):
    monkeypatch.setattr(phrases, "SLAB_BYTES", 16)
    text = babble(1, 300)[0] + "é . " + "x" * 40
    words = [w for slab in phrases.slabs(text.encode(), phrases._byte_table()) for w in slab]
    flat = [w.encode() for piece in pieces_of(text) for w in piece]
    assert [w for w in words if w != phrases.CUT] == flat


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 3}, {"longest": 2}, {"share": 90, "least": 4}])
def test_phrases_against_a_plain_loop(frame, monkeypatch, options):
    monkeypatch.setattr(phrases, "SHARD_WORDS", 700)
    texts = babble(40, 120)
    docs = frame(list(enumerate(texts)), {i: ("en", "en", "de", None)[i % 4] for i in range(40)}).repartition(3)
    assert mined(docs, **options) == plain_phrases([(r["lang"], r["text"]) for r in docs.collect()], **options)
    assert mined(docs, most=5, **options) == plain_phrases([(r["lang"], r["text"]) for r in docs.collect()], most=5, **options)


def test_phrases_do_not_depend_on_the_bitmap(frame, monkeypatch):
    docs = frame(list(enumerate(babble(20, 150))), {i: "en" for i in range(20)})
    whole = mined(docs)
    monkeypatch.setattr(phrases, "SLOTS", 2**15)
    assert whole and mined(docs) == whole


def test_exact_scores_of_large_counts(spark):
    a, l, r = 987_654_321_987, 999_999_999_989, 999_999_999_961
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    big = [F.col(c).cast("decimal(15,0)") for c in "alr"]
    got = row.select(phrases.score(*big).alias("s")).first()["s"]
    assert got == 10**6 * a * a // (l * r)


def test_phrases_of_odd_and_empty_tables(odd, empty, frame):
    assert mined(odd) == plain_phrases([(r["lang"], r["text"]) for r in odd.collect()])
    assert mined(empty) == []
    repeated = frame([(1, "Same Words, here")] * 12 + [(2, None), (3, ""), (4, LONG), (5, "no break \x1c sign " * 11)])
    got = mined(repeated)
    assert got == plain_phrases([(r["lang"], r["text"]) for r in repeated.collect()])
    assert ("und", "same words") in {(g[0], g[2]) for g in got}
