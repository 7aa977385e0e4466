"""Secret scans with inferred grammars.

Credentials that the base patterns find in all texts are the labelled examples;
an automaton is fitted to a bounded number of each kind. Their prefix tree is folded by merging states whose outgoing
frequencies do not differ significantly (Hoeffding's bound), which gives one
probabilistic automaton per kind. Every run of credential characters in every
text is then scored: how much likelier, per character, it is under the best
automaton than as ordinary text of the same sample. Runs over the threshold are
spans of kind ``format``, unless they touch a base span; of each run, what
lies between equal signs or dots is scored too, and of those that overlap the
likeliest one counts. Base spans always stay.

A null or empty text has no spans. Without labelled examples only base spans are
found. Offsets count code points; repeated rows are scanned alike.
"""

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlens.llm.common import bounded_sample, by_batch, cut_lineage, sliced, texts_of, tidied

# fixed values: the base patterns of the contract, in the order in which kinds are listed
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")      # the same spans as maximal runs with 16 characters or more
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")     # alphabet and least length of labelled values
# what is scored of a run: all of it, and what lies between equal signs, dots, or either
PARTS = (RUN, *(re.compile(f"[A-Za-z0-9+/_{more}-]{{12,}}") for more in (".", "=", "")))

ALPHA = 0.05        # significance of the merge test
BITS = 1.0          # bits per character by which an automaton must beat ordinary text
END = ""


def base_spans(text):
    """(start, end, rank of kind, value) of the base matches."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0, m.group(1)) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 18]
    found += [(m.start(), m.end(), 2, m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


class Automaton:
    """A prefix tree of strings, folded into a deterministic probabilistic automaton."""

    def __init__(self, strings, alpha=ALPHA):
        self.next, self.count, self.stop = [{}], [0], [0]
        for string in strings:
            state = 0
            self.count[0] += 1
            for letter in string:
                if letter not in self.next[state]:
                    self.next[state][letter] = (len(self.next), 0)
                    self.next.append({}), self.count.append(0), self.stop.append(0)
                to, n = self.next[state][letter]
                self.next[state][letter] = (to, n + 1)
                state = to
                self.count[state] += 1
            self.stop[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._fold()

    def _apart(self, n, a, m, b):
        return n and m and abs(n / a - m / b) > self.bound * (1 / math.sqrt(a) + 1 / math.sqrt(b))

    def _compatible(self, left, right):
        work = [(left, right)]
        while work:
            a, b = work.pop()
            na, nb = self.count[a], self.count[b]
            if not na or not nb:
                continue
            differ = lambda x, y: abs(x / na - y / nb) > self.bound * (na ** -0.5 + nb ** -0.5)
            if differ(self.stop[a], self.stop[b]):
                return False
            for letter in self.next[a].keys() | self.next[b].keys():
                to_a, x = self.next[a].get(letter, (None, 0))
                to_b, y = self.next[b].get(letter, (None, 0))
                if differ(x, y):
                    return False
                if to_a is not None and to_b is not None and to_a != to_b:
                    work.append((to_a, to_b))
        return True

    def _merge(self, into, other):
        work = [(into, other)]
        while work:
            a, b = work.pop()
            self.count[a] += self.count[b]
            self.stop[a] += self.stop[b]
            for letter, (to, n) in self.next[b].items():
                if letter in self.next[a]:
                    own, m = self.next[a][letter]
                    self.next[a][letter] = (own, m + n)
                    if own != to:
                        work.append((own, to))
                else:
                    self.next[a][letter] = (to, n)
            self.next[b], self.count[b] = {}, 0

    def _fold(self):
        """Red states are final; a blue one, a child of a red state, is merged with a red one or turns red."""
        red = [0]
        while True:
            blue = sorted(
                (-n, to, state, letter) for state in red for letter, (to, n) in self.next[state].items() if to not in red
            )
            if not blue:
                break
            _, state, parent, letter = blue[0]
            for known in red:
                if self._compatible(known, state):
                    self.next[parent][letter] = (known, self.next[parent][letter][1])
                    self._merge(known, state)
                    break
            else:
                red.append(state)
        place = {state: i for i, state in enumerate(red)}
        self.next = [{c: (place[to], n) for c, (to, n) in self.next[s].items()} for s in red]
        self.stop = [self.stop[s] for s in red]
        self.count = [self.stop[i] + sum(n for _, n in self.next[i].values()) for i in range(len(red))]

    def bits(self, string):
        """log2 of the string's probability; a letter without an arc costs as one unseen symbol."""
        state, total = 0, 0.0
        for letter in string:
            to, n = self.next[state].get(letter, (state, 0))
            total += math.log2((n + 0.01) / (self.count[state] + 0.64))
            state = to
        return total + math.log2((self.stop[state] + 0.01) / (self.count[state] + 0.64))


class Ordinary:
    """Pairs of neighbouring characters in runs that are no credentials."""

    def __init__(self, runs):
        self.pairs, self.singles = Counter(), Counter()
        for run in runs:
            self.pairs.update(zip(" " + run, run))
            self.singles.update(" " + run[:-1])

    def bits(self, string):
        return sum(
            math.log2((self.pairs[a, b] + 0.5) / (self.singles[a] + 32)) for a, b in zip(" " + string, string)
        )


def learn(documents: DataFrame, rows=20_000, per_kind=400):
    """Automata and the model of ordinary runs, from at most ``per_kind`` strings a kind.

    Labelled strings are looked for in all texts, so a kind is learned however rare it is, if ten
    distinct strings of it occur at all. Only the ordinary runs come from at most ``rows`` texts.
    """
    def labelled():
        def step(rows):
            found = {(KINDS[k], value) for text in rows["text"] for _, _, k, value in base_spans(text or "")}
            found = sorted(found)
            return {"kind": [k for k, _ in found], "value": [v for _, v in found]}

        return step

    def unlabelled():
        def step(rows):
            found = set()
            for text in rows["text"]:
                spans = base_spans(text or "")
                found.update(
                    m.group() for m in RUN.finditer(text or "")
                    if not any(s < m.end() and m.start() < e for s, e, *_ in spans)
                )
            return {"kind": ["ordinary"] * len(found), "value": sorted(found)}

        return step

    def strings(texts, work):
        found = by_batch(texts.select("text"), work, "kind string, value string").where(F.length("value") <= 256)
        # kept, as it is counted and then picked from; at most per_kind for each kind reach the driver
        return bounded_sample(cut_lineage(found.distinct()), "value", per_kind, "kind").collect()

    ids = documents.where("doc_id is not null").select("doc_id", F.lit(0).alias("one"))
    sample = texts_of(documents, bounded_sample(ids, "doc_id", rows, "one").select("doc_id"))
    picked = strings(documents, labelled) + strings(sample, unlabelled)
    of = lambda kind: sorted(r["value"] for r in picked if r["kind"] == kind)
    return [(k, Automaton(of(k))) for k in KINDS if len(of(k)) >= 10], Ordinary(of("ordinary"))


def all_spans(text, automata, ordinary, threshold=BITS):
    """(start, end, kind) of base and added spans, by start, then kind as listed."""
    base = base_spans(text)
    spans = [(s, e, k) for s, e, k, _ in base]
    if automata:
        likely = []
        for run in RUN.finditer(text):
            for start, end in {m.span() for part in PARTS for m in part.finditer(text, *run.span())}:
                value = text[start:end]
                if any(s < end and start < e for s, e, *_ in base):
                    continue
                gain = max(a.bits(value) for _, a in automata) - ordinary.bits(value)
                if gain / len(value) > threshold:
                    likely.append((-gain, start, end))
        for _, start, end in sorted(likely):    # a run or its parts, whatever is the likeliest
            if not any(s < end and start < e for s, e, _ in spans):
                spans.append((start, end, len(KINDS)))
    names = (*KINDS, "format")
    return base, [(s, e, names[k]) for s, e, k in sorted(spans, key=lambda x: (x[0], x[2]))]


def scan(documents: DataFrame, models) -> DataFrame:
    """``doc_id, spans array<struct<start,end,kind>>, base`` for each row; one map stage over whole texts."""
    automata, ordinary = models

    def work():
        def step(rows):
            spans, base = [], []
            for text in rows["text"]:
                plain, every = all_spans(text or "", automata, ordinary)
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in every])
                base.append([{"start": s, "end": e, "kind": KINDS[k]} for s, e, k, _ in plain])
            return {"doc_id": rows["doc_id"], "spans": spans, "base": base}

        return step

    span = "array<struct<start: int, end: int, kind: string>>"
    return by_batch(documents.select("doc_id", "text"), work, f"doc_id long, spans {span}, base {span}")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of base kinds, the digest of base spans and all spans as text."""
    listed = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *(count(k) for k in KINDS),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


def redact(documents: DataFrame, models, mark="[SECRET]") -> DataFrame:
    """The same rows and columns with every span of ``text`` replaced, and ``n_chars`` counted anew."""
    automata, ordinary = models

    def work():
        def clean(text):
            if text is None:
                return None
            out, at = [], 0
            for start, end, _ in all_spans(text, automata, ordinary)[1]:
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return "".join(out) + text[at:] if out else text

        return clean

    names = documents.columns

    def run(batches):
        clean = work()
        for batch in sliced(batches):
            texts = [clean(t) for t in batch.column(names.index("text")).to_pylist()]
            new = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
            columns = [
                pa.array(new[name], field.type) if name in new else column
                for name, field, column in zip(names, batch.schema, batch.columns)
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(tidied(run), documents.schema)

