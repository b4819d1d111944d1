"""Toxicity of whole texts: a learned lexicon in a trie, misspellings caught by Levenshtein automata, windows of context scored.

- The lexicon holds words and word beginnings (of ``STEM`` letters or more, any ending) that labelled toxic documents have far
  more often than others. Each entry weighs as much as the lower bound of its log odds.
- ``Automaton`` walks the trie and the Levenshtein automata of all its entries at once: a state is a set of (node, edits so far), made
  when it is first reached and kept as one number, so a word costs one look-up per letter. Entries of 5 letters or more allow one edit,
  of 9 or more two. How much a misspelling of an entry counts is learned too, per entry and number of edits: much where such words
  stand in toxic documents only, nothing where they are ordinary words. A word known from clean documents is never a misspelling.
- Each hit is judged in its window of ``REACH`` words to either side: the weights of the hits there add up. A hit inside quotation
  marks, in a line that begins with ``>``, or beside a word that reports speech counts ``QUOTED`` of its weight, so that a text
  which quotes abuse scores below one that abuses.

A document's features (heaviest window, weight per 100 words, total weight) go into a logistic regression. Lexicon, misspellings and
regression are learned from at most ``SAMPLE`` documents per label outside the held fold, taken by a hash of doc_id, weighted to the
shares of all labels; copies with the same rarest words count once. A null or empty text has no hits and scores like any clean one;
without labels of both kinds every score is the share of toxic labels, 0.5 without any. Repeated rows score alike, of contradictory
labels of a document the larger counts; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.common import held_out_key, keep

SAMPLE = 6_000
TERMS = 4_000
FAMILIAR = 20_000
STEM = 5
REACH = 12
QUOTED = 0.25
LEAST_ODDS = 2.0
WORD = re.compile(r"[^\W\d_][^\s,.;:!?|/()\[\]{}<>«»„“”\"]*")
TAIL = re.compile(r"[\W_]+$")
QUOTE = re.compile(r'"[^"\n]{1,400}"|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]|«[^»\n]{1,400}»|^[ \t]*>.*$', re.M)
#: Words that report what others say, in the languages of the given tables.
REPORTING = frozenset("said says wrote writes called calls quote quoted word term sagte schrieb nannte wort zitat dit écrit appelé mot cité dijo escribió llamó palabra cita".split())


def words_of(text: str) -> list[str]:
    return [TAIL.sub("", w) for w in WORD.findall(text.lower())]


def allowed(term: str) -> int:
    """Edits that a misspelling of ``term`` may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All words within the allowed edits of the entries; entries ending in ``*`` accept any ending."""

    def __init__(self, entries: list[str], most: int = 200_000):
        self.most = most
        self.children: list[dict[str, int]] = [{}]
        self.entry, self.open, self.budget = [-1], [-1], [0]
        self.edits = []
        for number, entry in enumerate(entries):
            term = entry.rstrip("*")
            edits = allowed(term) if not entry.endswith("*") else min(1, allowed(term))
            self.edits.append(edits)
            at = 0
            self.budget[0] = max(self.budget[0], edits)
            for letter in term:
                if letter not in self.children[at]:
                    self.children[at][letter] = len(self.children)
                    self.children.append({})
                    self.entry.append(-1)
                    self.open.append(-1)
                    self.budget.append(0)
                at = self.children[at][letter]
                self.budget[at] = max(self.budget[at], edits)
            (self.open if entry.endswith("*") else self.entry)[at] = number
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._number(self._closed({(0, 0)}), frozenset())

    def _closed(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With the nodes reached by leaving letters of an entry out."""
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.budget[child] and (child, edits + 1) not in pairs:
                    pairs.add((child, edits + 1))
                    todo.append((child, edits + 1))
        return pairs

    def _number(self, pairs: set[tuple[int, int]], ended: frozenset) -> int:
        """The state's number; of the pairs of a node only the least edits count. ``ended``: open entries met, (edits, entry)."""
        least: dict[int, int] = {}
        for node, edits in pairs:
            least[node] = min(edits, least.get(node, 9))
        ended = ended | {(e, self.open[n]) for n, e in least.items() if self.open[n] >= 0 and e <= self.edits[self.open[n]]}
        ended = frozenset([min(ended)]) if ended else ended
        key = frozenset(least.items()), ended
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            whole = [(e, self.entry[n]) for n, e in least.items() if self.entry[n] >= 0 and e <= self.edits[self.entry[n]]]
            best = min([*whole, *ended], default=None, key=lambda m: (m[0], (m[0], m[1]) in ended, m[1]))
            self.accepts.append((best[1], best[0]) if best else None)
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        pairs, ended = self.states[state]
        out = set()
        for node, edits in pairs:
            for own, child in self.children[node].items():
                cost = edits + (own != letter)
                if cost <= self.budget[child]:
                    out.add((child, cost))
            if edits + 1 <= self.budget[node]:
                out.add((node, edits + 1))
        found = self._number(self._closed(out), ended) if out or ended else -1
        self.steps[state][letter] = found
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the nearest entry, whole ones before open ones; None if there is none."""
        if len(self.states) > self.most:
            self.clear()
        state = self.start
        for letter in word:
            after = self.steps[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if state < 0:
                return None
        return self.accepts[state]


class Lexicon:
    """Entries with weights, factors of their misspellings by edits, and words that are none."""

    def __init__(self, weights: dict[str, float]):
        self.entries = sorted(weights)
        self.weights = [weights[e] for e in self.entries]
        self.factors: dict[tuple[int, int], float] = {}
        self.familiar: frozenset[str] = frozenset()

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k not in ("automaton", "known")}

    def look(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of a word, kept for as long as there is room."""
        if "automaton" not in vars(self):
            self.automaton, self.known = Automaton(self.entries), {}
        if len(self.known) > 500_000:
            self.known.clear()
        if word not in self.known:
            found = self.automaton.match(word)
            self.known[word] = None if found and found[1] and word in self.familiar else found
        return self.known[word]

    def weight(self, found: tuple[int, int]) -> float:
        entry, edits = found
        return self.weights[entry] * (self.factors.get((entry, edits), HALF) if edits else 1.0)

    def hits(self, text: str) -> tuple[int, list[tuple[int, str, tuple[int, int], bool]]]:
        """(words, hits): place, word, match and whether it is quoted."""
        words = words_of(text)
        if not any(self.look(w) for w in set(words)):
            return len(words), []
        low = text.lower()
        inside = [m.span() for m in QUOTE.finditer(low)]
        out, k = [], 0
        for at, (word, m) in enumerate(zip(words, WORD.finditer(low))):
            found = self.look(word)
            if not found:
                continue
            while k < len(inside) and inside[k][1] <= m.start():
                k += 1
            quoted = k < len(inside) and inside[k][0] <= m.start() or not REPORTING.isdisjoint(words[max(0, at - 3):at + 4])
            out.append((at, word, found, quoted))
        return len(words), out

    def windows(self, text: str) -> list[tuple[int, float]]:
        """(place, score) of the window around each hit."""
        return self._windows(self.hits(text)[1])

    def _windows(self, hits) -> list[tuple[int, float]]:
        if not hits:
            return []
        place = np.array([h[0] for h in hits])
        weight = np.array([self.weight(h[2]) * (QUOTED if h[3] else 1.0) for h in hits])
        total = np.r_[0, np.cumsum(weight)]
        score = total[np.searchsorted(place, place + REACH, "right")] - total[np.searchsorted(place, place - REACH, "left")]
        return list(zip(place.tolist(), score.tolist()))

    def features(self, text: str | None) -> list[float]:
        """Heaviest window, weight per 100 words, and total weight, on scales near one."""
        words, hits = self.hits(text or "")
        if not hits:
            return [0.0, 0.0, 0.0]
        total = sum(self.weight(h[2]) * (QUOTED if h[3] else 1.0) for h in hits)
        return [math.log1p(max(s for _, s in self._windows(hits))), math.log1p(100 * total / max(1, words)), math.log1p(total)]


#: What a misspelling counts before anything is known of it.
HALF = 0.5
#: Documents with misspellings of an entry that weigh as much as that assumption.
DOUBT = 2.0


class Model:
    def __init__(self, lexicon: Lexicon | None, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        x = self.lexicon.features(text) if self.lexicon else [0.0] * 3
        return 1 / (1 + math.exp(-float(self.weights[0] + np.dot(self.weights[1:], x))))


def odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    """Lower bound of the log odds that a document with this entry is toxic, against one without."""
    a, b = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    spread = math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5) - 1 / (n_toxic + 1) - 1 / (n_clean + 1))
    return math.log(a / b) - spread


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, pull: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps: (constant, weights)."""
    x = np.c_[np.ones(len(x)), x]
    beta, w = np.zeros(x.shape[1]), w / w.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - pull * np.r_[0, beta[1:]]
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(np.r_[1e-9, np.full(x.shape[1] - 1, pull)])
        change = np.linalg.solve(curve, slope)
        beta += change
        if np.abs(change).max() < 1e-8:
            break
    return beta


def _entries(words: set[str]) -> Iterator[str]:
    for word in words:
        if 2 < len(word) <= 40:
            yield word
            for end in range(STEM, min(len(word), 16)):
                yield word[:end] + "*"


def _signature(words: list[str]) -> int:
    """Least hash of three words in a row: near copies mostly share it."""
    runs = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    return min(xxhash.xxh64_intdigest(r) for r in runs) >> 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: documents of either label with each entry, in partial counts of bounded size."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])

    def out():
        made = pa.record_batch([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["entry", "toxic", "clean"])
        counts.clear()
        return made

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for entry in set(_entries(set(words_of(text or "")))):
                counts[entry][1 - toxic] += 1
            if len(counts) > 300_000:
                yield out()
    yield out()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        made = [_signature(words_of(t)) if t else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, "signature"])


def _near(lexicon: Lexicon):
    """Task: words that are no entry but within the allowed edits of one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, (text, toxic) in enumerate(zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())):
                for word in set(words_of(text or "")):
                    found = lexicon.look(word)
                    if found and found[1]:
                        rows.append((word, *found, toxic))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["word", "entry", "edits", "toxic"])

    return run


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def lexicon_of(rows: DataFrame, n_toxic: int, n_clean: int, terms: int = TERMS) -> Lexicon:
    """Entries of ``rows`` (text, toxic) with their weights; a beginning stands in only where it says more than its words."""
    counts = rows.select("text", "toxic").mapInArrow(_counted, "entry string, toxic long, clean long")
    counts = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic >= 3")
    # sure to hold every entry above the bound: toxic documents with it, in the wanted ratio to clean ones
    ratio = math.exp(LEAST_ODDS) * n_toxic / max(1, n_clean)
    counts = counts.filter(F.col("toxic") + 0.5 >= ratio * (F.col("clean") + 0.5)).orderBy(F.desc(F.col("toxic") - ratio * F.col("clean")), "entry").limit(4 * terms)
    weights = {r["entry"]: odds(r["toxic"], r["clean"], n_toxic, n_clean) for r in counts.collect()}
    weights = {e: w for e, w in weights.items() if w >= LEAST_ODDS}
    # a beginning that is no better than a shorter one, or than one word that has it, adds nothing
    by_stem: dict[str, float] = {}
    for word in [e for e in weights if not e.endswith("*")]:
        for end in range(STEM, len(word) + 1):
            by_stem[word[:end]] = max(by_stem.get(word[:end], 0.0), weights[word])
    for entry in sorted(weights, key=len, reverse=True):
        stem = entry.rstrip("*")
        shorter = max((weights.get(stem[:k] + "*", 0.0) for k in range(STEM, len(stem))), default=0.0)
        if entry.endswith("*") and max(shorter, by_stem.get(stem, 0.0)) >= weights[entry]:
            del weights[entry]
    best = sorted(weights, key=lambda e: (-weights[e], e))[:terms]
    return Lexicon({e: weights[e] for e in best})


def learn_misspellings(lexicon: Lexicon, rows: DataFrame, n_toxic: int, n_clean: int, familiar: int = FAMILIAR) -> None:
    """Finds the ordinary words near entries, then how much other misspellings of each entry say."""
    near = rows.select("text", "toxic").mapInArrow(_near(lexicon), "word string, entry int, edits int, toxic int")
    by_word = near.groupBy("word", "entry", "edits").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    by_word = keep(by_word, "near-words")
    usual = by_word.filter("clean >= 2").orderBy(F.desc("clean"), "word").limit(familiar)
    lexicon.familiar = frozenset(r["word"] for r in usual.collect())
    rest = by_word.join(usual.select("word"), "word", "left_anti").groupBy("entry", "edits").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    for r in rest.toLocalIterator():  # at most two rows per entry
        toxic, clean = r["toxic"] / max(1, n_toxic), r["clean"] / max(1, n_clean)
        share = (toxic - clean) / max(toxic + clean, 1e-12)
        seen = r["toxic"] + r["clean"]
        lexicon.factors[r["entry"], r["edits"]] = max(0.0, (seen * max(0.0, share) + DOUBT * HALF) / (seen + DOUBT) if share > 0 else HALF * DOUBT / (seen + DOUBT))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` documents per value of ``labels`` (doc_id, toxic 0/1) that are not of the held fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(held_out_key("doc_id"), F.lit(folds)) != held)).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")
    )
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_all = sum(totals.values())
    if len(totals) < 2:
        share = (totals.get(1, 0) + 0.5) / (n_all + 1)
        return Model(None, np.array([math.log(share / (1 - share)), 0, 0, 0]))
    parts = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * sample ids are broadcast
    rows = texts.join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.mapInArrow(_signed, "doc_id long, text string, toxic int, signature long")
    rows = keep(rows.dropDuplicates(["toxic", "signature"]).repartition(F.col("doc_id")), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        share = (totals[1] + 0.5) / (n_all + 1)
        return Model(None, np.array([math.log(share / (1 - share)), 0, 0, 0]))
    lexicon = lexicon_of(rows, sizes[1], sizes[0])
    learn_misspellings(lexicon, rows, sizes[1], sizes[0])
    got = rows.select("text", "toxic").mapInArrow(_featured(lexicon), "toxic int, x array<double>").toArrow()
    # sums of floats depend on their order, so the rows of the sample get one
    sample_rows = sorted(zip(got.column("toxic").to_pylist(), got.column("x").to_pylist()))
    y = np.array([r[0] for r in sample_rows], np.float64)
    x = np.array([r[1] for r in sample_rows], np.float64).reshape(-1, 3)
    each = {k: totals[k] / sizes[k] for k in (0, 1)}
    return Model(lexicon, fit(x, y, np.where(y > 0, each[1], each[0])))


def score(docs: DataFrame, model: Model, folds: int = 3, held: int = 1, limit: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [round(own.score(t.as_py()), 6) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(F.pmod(held_out_key("doc_id"), F.lit(folds)) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )
