"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Labelled texts (a bounded sample) give the learned lexicon: words and word
beginnings that many toxic and hardly any clean texts hold. They are dealt into
parts by a hash of the text, and a text's features for training use a lexicon
learned from the other parts, so none is judged by a lexicon that it is in. Most
texts train the trees, the rest fit the calibration. Scoring uses the lexicon of
all parts; it is one map stage and the models' own transforms.

Features: densities and distinct numbers of lexicon hits, their closeness to
words of address, shares of capitals and punctuation, runs of marks, and rates of
words that hide letters behind digits or signs.

Null and empty texts have features of zero and get a score like any text. If the
labels hold one class only, every score is 0 or 1 by it; without labels it is 0.
"""

import math
import re
from collections import Counter

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import bounded_sample, by_batch, cut_lineage, texts_of

PER_CLASS = 5000        # labelled rows of each class to learn from, at most
LEXICON = 4000          # learned entries, at most; a parameter of the model like its depth
MIN_TEXTS, MIN_GAIN = 4, 3.0
PARTS = 3
SAMPLE_TASKS = 12       # the bounded sample is small: many rounds over few partitions

# fixed values: a short public list of insults, and words of address, for English, German, French and Spanish
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless trash garbage scum clown disgusting "
    "ugly hate fool jerk bastard dumm dummkopf arschloch idioten blöd trottel abschaum wertlos ekelhaft "
    "idiota imbécil estúpido estúpida basura tonto tonta asqueroso idiote imbécile stupide connard ordure crétin dégoûtant".split()
)
YOU = frozenset(
    "you your yours you're ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
    "tú ti contigo usted ustedes vosotros".split()
)
FEATURES = (
    "learned_rate", "learned_distinct", "learned_weight", "listed_rate", "listed_distinct", "near_you", "you_rate",
    "capital_rate", "shout_rate", "mark_rate", "mark_runs", "hidden_rate", "hidden_hits", "log_words",
)
TOKEN = re.compile(r"[^\s.,;:!?\"()\[\]]+")
HIDDEN = re.compile(r"[^\W\d_][*@$!#0134578|+._-]+[^\W\d_]")
PLAIN = str.maketrans("013457@$!|", "oieastasil")
MARKS = re.compile(r"[!?]{2,}")
CAPITALS = re.compile(r"[A-Z\u00c0-\u00d6\u00d8-\u00de]")
KEEP = 300_000          # words whose entries a task remembers
STEMS = range(4, 8)     # lengths of word beginnings


def tokens(text):
    return TOKEN.findall(text.lower())


def entries(word):
    """What the lexicon may know of a word: itself, and its beginnings with a mark."""
    return [word, *(word[:n] + "~" for n in STEMS if n < len(word))]


def revealed(word):
    """A word of letters and other signs with the signs read as letters or taken out, else None."""
    if word.isalpha() or not any(map(str.isalpha, word)):
        return None
    return re.sub(r"[\W\d_]", "", word.translate(PLAIN))


def starred(word):
    """Whether stars in a word stand for the letters of an insult."""
    inner = word.strip("*")
    if "*" not in inner:
        return False
    shape = re.compile(re.escape(inner).replace(r"\*", "."))
    return any(shape.fullmatch(insult) for insult in INSULTS)


class Judge(dict):
    """What is known of each word: None of most, else (gain, listed, hidden, hidden insult)."""

    def __init__(self, lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.starts = {entry[:STEMS[0]].rstrip("~") for entry in lexicon}

    def __missing__(self, word):
        gain = 0.0
        if word[:STEMS[0]] in self.starts:
            gain = max(self.lexicon.get(e, 0.0) for e in entries(word))
        if not gain and word.isalpha():
            found = self[word] = (0.0, True, False, False) if word in INSULTS else None
            return found
        bare = revealed(word)
        hidden = bool(HIDDEN.search(word)) if bare else False
        insult = bool(bare) and (bare in INSULTS or bare in self.lexicon or starred(word))
        known = (gain, word in INSULTS, hidden, insult)
        self[word] = found = known if any(known) else None
        return found

    def features(self, text):
        """The numbers of ``FEATURES`` for a whole text."""
        if len(self) > KEEP:
            self.clear()
        words = tokens(text)
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        found = [(i, k) for i, k in enumerate(map(self.__getitem__, words)) if k is not None]
        weight = {words[i]: k[0] for i, k in found if k[0]}
        listed = {words[i] for i, k in found if k[1]}
        bad = [i for i, k in found if k[0] or k[1]]
        you = [i for i, w in enumerate(words) if w in YOU]
        near, at = 0, 0
        for i in bad:
            while at < len(you) and you[at] < i - 5:
                at += 1
            near += at < len(you) and you[at] <= i + 5
        capitals, marks = len(CAPITALS.findall(text)), text.count("!") + text.count("?")
        shouts = sum(len(w) > 2 and w.isupper() for w in text.split()) if capitals > n / 2 else 0
        return [
            sum(bool(k[0]) for _, k in found) / n, float(len(weight)), float(sum(weight.values())),
            sum(k[1] for _, k in found) / n, float(len(listed)), near / n, len(you) / n,
            capitals / len(text), shouts / n, marks / n, float(len(MARKS.findall(text))) if marks > 1 else 0.0,
            sum(k[2] for _, k in found) / n, float(sum(k[3] for _, k in found)), math.log1p(n),
        ]


def features(text, lexicon):
    return Judge(lexicon).features(text)


def learn_lexicons(sample: DataFrame) -> dict:
    """``{part: entries with their log odds}``: for each part one learned from the others, at None from all.

    Counting and choosing run on Spark; at most ``LEXICON`` rows of each come back.
    """
    def work():
        def step(rows):
            found = Counter()
            for text, toxic, part in zip(rows["text"], rows["toxic"], rows["part"]):
                found.update((e, toxic, part) for e in {e for w in set(tokens(text or "")) for e in entries(w)})
            entry, toxic, part = zip(*found) if found else ((), (), ())
            return {"entry": list(entry), "toxic": list(toxic), "part": list(part), "n": list(found.values())}

        return step

    totals = Counter({(r["toxic"], r["part"]): r["n"] for r in sample.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()})
    count = lambda toxic, part: F.sum(
        F.when((F.col("toxic") == toxic) & (F.col("part") == part), F.col("n")).otherwise(0)
    ).alias(f"n{toxic}{part}")
    counted = cut_lineage(
        by_batch(sample.select("text", "toxic", "part"), work, "entry string, toxic int, part int, n long")
        .groupBy("entry").agg(*(count(t, p) for t in (0, 1) for p in range(PARTS)))
        .where("+".join(f"n1{p}" for p in range(PARTS)) + f" >= {MIN_TEXTS}")
    )
    found = {}
    for left_out in (*range(PARTS), None):
        used = [p for p in range(PARTS) if p != left_out]
        bad_all, good_all = (sum(totals[t, p] for p in used) for t in (1, 0))
        bad, good = (sum((F.col(f"n{t}{p}") for p in used), F.lit(0)) for t in (1, 0))
        gain = F.log((bad + 0.5) / (bad_all + 1.0)) - F.log((good + 0.5) / (good_all + 1.0))
        # entries of many texts first, so that the words of one text and its copies come last
        chosen = (
            counted.select("entry", bad.alias("bad"), gain.alias("gain"))
            .where((F.col("bad") >= MIN_TEXTS) & (F.col("gain") >= MIN_GAIN))
            .orderBy(F.desc("bad"), F.desc("gain"), "entry").limit(LEXICON)
        )
        found[left_out] = {row["entry"]: row["gain"] for row in chosen.collect()} if bad_all and good_all else {}
    return found


def featured(rows: DataFrame, lexicons: dict, keep) -> DataFrame:
    """``keep`` and ``features`` (array of double) of each row's ``text``, by the lexicon of its ``part`` if it has one."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def work():
        judges = {part: Judge(lexicon) for part, lexicon in shared.value.items()}
        return lambda batch: {
            **{k: batch[k] for k in keep},
            "features": [
                judges[p].features(t or "")
                for t, p in zip(batch["text"], batch.get("part") or [None] * len(batch["text"]))
            ],
        }

    return by_batch(rows.select(*keep, "text"), work, f"{kinds}, features array<double>")


def train(documents: DataFrame, labels: DataFrame, per_class=PER_CLASS):
    """``(lexicons, trees, calibration)``; trees are None if one class only (``calibration`` is its score)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int"))
    sample = texts_of(documents, bounded_sample(known, "doc_id", per_class, "toxic").dropDuplicates(["doc_id"]))
    # copies of a text count once
    sample = cut_lineage(
        sample.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["h"])
        .withColumn("fold", F.pmod("h", F.lit(10))).withColumn("part", F.pmod(F.shiftright("h", 8), F.lit(PARTS)).cast("int"))
        .coalesce(SAMPLE_TASKS)
    )
    lexicons = learn_lexicons(sample)
    rows = cut_lineage(
        featured(sample.select("text", "toxic", "fold", "part"), lexicons, ["toxic", "fold", "part"])
        .select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("features").alias("features"))
    )
    lexicon = {None: lexicons[None]}
    fit, check = rows.where("fold < 8"), rows.where("fold >= 8")
    classes = sorted(r[0] for r in fit.select("label").distinct().collect())
    if len(classes) < 2:
        mean = known.agg(F.avg("toxic")).first()[0]
        return lexicon, None, float((mean or 0.0) >= 0.5)
    trees = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=7, maxBins=64).fit(fit)
    judged = trees.transform(check).select(
        "label", vector_to_array("probability")[1].alias("raw"), F.lit(1.0).alias("weight")
    )
    if judged.select("label").distinct().count() < 2:
        return lexicon, trees, None
    return lexicon, trees, IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(judged)


def score(documents: DataFrame, model) -> DataFrame:
    """``doc_id, score, predicted`` for each row."""
    lexicons, trees, calibration = model
    rows = featured(documents.select("doc_id", "text"), lexicons, ["doc_id"])
    if trees is None:
        out = rows.select("doc_id", F.lit(calibration).alias("score"))
    else:
        out = trees.transform(rows.withColumn("features", array_to_vector("features"))).select(
            "doc_id", vector_to_array("probability")[1].alias("raw")
        )
        out = calibration.transform(out) if calibration is not None else out.withColumn("score", F.col("raw"))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
