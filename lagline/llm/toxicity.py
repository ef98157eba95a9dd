"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, other; a clause ends
at closing punctuation or a line end. One small transducer per phenomenon reads the symbols:
the target machine remembers an addressee, the negation machine a negation within the last
three words, the speech machine that somebody is quoted. Their composition emits an event for
every insult or threat, and at the end of the clause names it: plain, targeted, threatening,
negated or reported. A document's score is a logistic function of the weights of its matched
clauses, so an isolated word counts by the clause it stands in.

Insult words carry weights. A seed list is given; further stems come from at most
``SAMPLE_ROWS`` labelled texts per label outside the held-out fold, as word beginnings that are
far more frequent in toxic texts (each two-word context counts once, so copies of a text do not
vote). The same sample fits the logistic. Scoring reads every whole text.

Nulls and empty texts have no clauses and get the score of a text without events. Without any
labels the seed list scores alone. Repeated rows are scored alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lagline.llm import labelled

FOLDS, FOLD = 5, 0
SAMPLE_ROWS = 2000
LONGEST = 20_000  # longer texts are scored, but don't teach
VOCABULARY = 1 << 19

# Word lists in English, German, French and Spanish.
INSULTS = (
    "idiot moron stupid loser trash scum clown pathetic worthless disgusting "
    "dummkopf trottel abschaum wertlos widerlich "
    "imbécile crétin minable ordure abruti "
    "idiota imbécil estúpido basura escoria inútil"
).split()
THREATS = "kill hurt destroy beat shoot töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your you're ihr dich du dir dein deine euch tu toi vous votre ton te tú usted ustedes vosotros tus".split()
NEGATIONS = "not no never don't isn't aren't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
SPEECH = (
    "said says wrote writes claimed called quoted sagte sagt schrieb behauptete nannte "
    "dit écrit appelé affirmé dijo dice escribió llamó afirmó"
).split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
PLAIN, TARGETED, THREATENING, NEGATED, REPORTED = range(5)
SCOPE = 3  # words a negation reaches
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Transducer:
    """Deterministic transducer: (state, symbol) -> (state, what it says of an event there)."""

    def __init__(self, arcs: dict[tuple[int, int], int], says: dict[int, str] | None = None):
        self.arcs, self.says = arcs, says or {}

    def step(self, state: int, symbol: int) -> int:
        return self.arcs.get((state, symbol), self.arcs.get((state, OTHER), state))


def machines() -> dict[str, Transducer]:
    counting = {(s, x): max(0, s - 1) for s in range(SCOPE + 1) for x in range(6)}
    counting |= {(s, NEGATION): SCOPE for s in range(SCOPE + 1)}
    return {
        "insult": Transducer({(0, INSULT): 1, (1, INSULT): 1, (1, OTHER): 0}, {1: "insult"}),
        "threat": Transducer({(0, THREAT): 1, (1, THREAT): 1, (1, OTHER): 0}, {1: "threat"}),
        "target": Transducer({(0, TARGET): 1, (1, OTHER): 1}, {1: "target"}),
        "negation": Transducer(counting, {s: "negated" for s in range(1, SCOPE + 1)}),
        "report": Transducer({(0, REPORT): 1, (1, OTHER): 1}, {1: "reported"}),
    }


class Grammar:
    """The composition of the machines, with its product states made as they are met."""

    def __init__(self):
        self.parts = list(machines().values())
        self.start = (0,) * len(self.parts)
        self.arcs: dict[tuple, tuple[tuple, frozenset]] = {}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, frozenset]:
        known = self.arcs.get((state, symbol))
        if known is None:
            before = [m.says[s] for m, s in zip(self.parts, state) if s in m.says]
            after = tuple(m.step(s, symbol) for m, s in zip(self.parts, state))
            now = [m.says[s] for m, s in zip(self.parts, after) if s in m.says]
            # An event is negated by what stood before it; all else is read after the word.
            said = frozenset([x for x in now if x != "negated"] + [x for x in before if x == "negated"])
            known = self.arcs[state, symbol] = after, said
        return known

    def clause(self, symbols: list[int], weights: list[float]) -> list[tuple[int, float]]:
        """(kind, weight) of each event of one clause."""
        state, events, said = self.start, [], frozenset()
        for symbol, weight in zip(symbols, weights):
            state, said = self.step(state, symbol)
            if symbol in (INSULT, THREAT):
                events.append((symbol, said, weight))
        targeted = "target" in said
        kinds = []
        for symbol, when, weight in events:
            if "negated" in when:
                kind = NEGATED
            elif "reported" in when:
                kind = REPORTED
            elif symbol == THREAT:
                if not targeted:
                    continue  # a verb of violence without an addressee is no threat
                kind = THREATENING
            else:
                kind = TARGETED if targeted else PLAIN
            kinds.append((kind, weight))
        return kinds


class Lexicon:
    """Whole words and word beginnings with their symbol and weight."""

    def __init__(self, stems: dict[str, float]):
        self.words: dict[str, tuple[int, float]] = {}
        for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, SPEECH)):
            self.words |= {w: (symbol, 1.0) for w in words}
        self.words |= {w: (INSULT, 3.0) for w in INSULTS}
        self.stems = {}
        for stem, weight in stems.items():
            if stem.endswith("$"):
                self.words[stem[:-1]] = (INSULT, weight)
            else:
                self.stems[stem] = (INSULT, weight)
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.known: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def look_up(self, token: str) -> tuple[int, float]:
        word = _EDGE.sub("", token)
        found = self.words.get(word)
        if found is None:
            for n in self.lengths:
                found = self.stems.get(word[:n]) if len(word) >= n else None
                if found:
                    break
        return found or (OTHER, 0.0)

    def symbols(self, tokens: list[str]) -> list[tuple[int, float]]:
        known = self.known
        if len(known) > VOCABULARY:
            known.clear()
        get, out = known.get, []
        for token in tokens:
            value = get(token)
            if value is None:
                value = known[token] = self.look_up(token)
            out.append(value)
        return out


_CLOSING = (".", "!", "?", ";", ":")


class Model:
    """Lexicon, grammar and logistic coefficients."""

    def __init__(self, stems: dict[str, float]):
        self.lexicon, self.grammar = Lexicon(stems), Grammar()
        self.centre = self.spread = self.beta = None

    def events(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Weight and number of events by kind, and the number of words."""
        weight, number, words = np.zeros(5), np.zeros(5), 0
        for line in text.lower().split("\n"):
            tokens = line.split()
            words += len(tokens)
            found = self.lexicon.symbols(tokens)
            at = [i for i, (s, _) in enumerate(found) if s in (INSULT, THREAT)]
            end = 0
            for i in at:
                if i < end:
                    continue  # in the clause just read
                begin = i
                while begin > 0 and not tokens[begin - 1].endswith(_CLOSING):
                    begin -= 1
                end = i
                while end < len(tokens) and not tokens[end].endswith(_CLOSING):
                    end += 1
                end = min(end + 1, len(tokens))
                symbols, weights = zip(*found[begin:end])
                for kind, w in self.grammar.clause(symbols, weights):
                    weight[kind] += w
                    number[kind] += 1
        return weight, number, words

    def row(self, text: str) -> np.ndarray:
        weight, number, words = self.events(text)
        total = weight.sum()
        return np.array([
            np.log1p(total), np.log1p(100 * total / (words + 20)), np.log1p(number.sum()), np.log1p(words),
            np.sqrt(words / 100), *np.log1p(weight), float(number.sum() > 0), float(number.sum() > 1),
        ])

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> None:
        x = np.array([self.row(t) for t in texts])
        self.centre, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.c_[np.ones(len(x)), (x - self.centre) / self.spread]
        self.beta = labelled.logistic(x, y, weight)

    def score(self, text: str) -> float:
        row = self.row(text)
        if self.beta is None:  # no labels: any plain, targeted or threatening clause
            return float(1 - np.exp(-self.events(text)[0][:3].sum()))
        z = self.beta[0] + ((row - self.centre) / self.spread) @ self.beta[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn_stems(toxic: list[str], other: list[str], support: int = 8, ratio: float = 4.0, evidence: float = 40.0):
    """Word beginnings ("stem") and whole words ("word$") typical of toxic texts, with log ratios."""
    ids: dict[str, int] = {"": 0}

    def contexts(texts):
        """Occurrences per word, each pair with the word before it counted once."""
        parts = []
        for text in texts:
            row = [ids.setdefault(w, len(ids)) for w in (_EDGE.sub("", t) for t in text.lower().split())]
            row = np.array([0, *row], np.int64)
            parts.append(np.unique((row[:-1] << 32) | row[1:]))
        pairs = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        return np.bincount(pairs & 0xFFFFFFFF, minlength=len(ids)), len(pairs)

    bad, n_bad = contexts(toxic)
    good, n_good = contexts(other)
    if not n_bad or not n_good:
        return {}
    bad = np.pad(bad, (0, len(ids) - len(bad)))
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    names = list(ids)

    def beginnings(word):
        return [*(word[:n] for n in range(4, min(len(word), 12) + 1)), word + "$"]

    for i in np.flatnonzero(bad):
        for stem in beginnings(names[i]) if len(names[i]) > 2 else ():
            counts[stem][0] += int(bad[i])
    counts = {s: c for s, c in counts.items() if c[0] >= support}
    for i in np.flatnonzero(good):
        for stem in beginnings(names[i]):
            if stem in counts:
                counts[stem][1] += int(good[i])

    def gain(a, b):
        p, q, r = a / n_bad, b / n_good, (a + b) / (n_bad + n_good)
        return 2 * (a * np.log(p / r) + (b * np.log(q / r) if b else 0))

    ranked = sorted(
        ((gain(a, b), len(s), s, a, b) for s, (a, b) in counts.items() if a / n_bad >= ratio * (b + 0.5) / n_good),
        reverse=True,
    )
    chosen: dict[str, float] = {}
    for g, _, stem, a, b in ranked:
        if g < evidence:
            break
        bare = stem.rstrip("$")
        if any(bare.startswith(c.rstrip("$")) or c.startswith(bare) for c in chosen):
            continue
        chosen[stem] = float(min(6.0, np.log(a / n_bad) - np.log((b + 0.5) / n_good)))
    return chosen


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    texts, counts = labelled.sample(docs, labels, "toxic", FOLDS, FOLD, rows, LONGEST)
    toxic, other = texts.get("1", []), texts.get("0", [])
    model = Model(learn_stems(toxic, other))
    if toxic and other:
        y = np.r_[np.ones(len(toxic)), np.zeros(len(other))]
        each = np.r_[
            np.full(len(toxic), counts["1"] / len(toxic)), np.full(len(other), counts["0"] / len(other))
        ]
        model.fit(toxic + other, y, each * len(y) / each.sum())
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, clauses): one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", pa.int32())])

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            score = [shared.value.score(t) for t in texts]
            matched = [int(shared.value.events(t)[1].sum()) if s >= 0.5 else 0 for t, s in zip(texts, score)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array(matched, pa.int32())], schema=schema
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, clauses int").select(
        "doc_id",
        labelled.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("clauses").alias("clauses_in_toxic"),
    )


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents scored below 0.5, with all their columns."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = [shared.value.score(t.as_py() or "") < 0.5 for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
