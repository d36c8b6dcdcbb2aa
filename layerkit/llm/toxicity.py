"""Operator 4: toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, ...) by a fixed lexicon and by
stems learned from labels. Five small transducers, for negation, reported
speech, threats, insults and targets, read the symbols of a clause and weigh
them; they are composed into one automaton. An insulting word alone says next to
nothing: it takes a target in its clause, an epithet's opening ("such a"), or
another insult beside it. A document's evidence is the weight of its matched
clauses, and a logistic curve fitted on labels turns it into a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from layerkit.llm.common import begin, map_arrow, remember, runs
from layerkit.llm.nbsvm import labelled, logistic_curve, score_column

# Labelled rows that stems and curve are learned from at most, about.
FIT_ROWS = 20_000
# Documents and differing left neighbours that a stem needs among toxic rows.
LEAST_DOCS, LEAST_CONTEXTS = 5, 5
# Share of toxic rows with a stem against the share of the others, at least.
LEAST_RATIO = 50.0
STEM_LENGTHS = (4, 5, 6)
_SEED_WEIGHT = 3.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, OPENING = SYMBOLS = range(8)
# Share of its weight that an insulting word keeps where no construction makes it an insult, and what a target behind it gives back.
_LONE, _AIMED_LATE = 0.1, 2.5

LEXICON = {
    INSULT: """idiot idiots moron morons stupid loser losers scum trash clown clowns pathetic disgusting worthless
        imbecile dumb dimwit vermin filth lowlife brainless cretin degenerate retarded bastard bitch asshole
        abschaum idioten versager arschloch dummkopf connard salaud imbécile ordure idiota imbécil estúpido basura""",
    THREAT: "kill hurt destroy beat stab shoot strangle murder töten umbringen tuer frapper matar golpear",
    TARGET: """you your yours you're youre u he she they them him her du dich dir ihr euch sie tu toi te vous il elle ils
        tú usted ustedes él ella ellos eres""",
    NEGATION: "not no never nobody isn't aren't don't nicht kein keine nie pas jamais aucun nunca ningún jamás",
    REPORT: """said says saying quoted quote wrote writes reported claims claimed called calls alleged according
        sagte sagt schrieb dit écrit dijo dice escribió""",
    INTENT: "will gonna going shall should must i'll we'll werde werden vais allons voy vamos",
    OPENING: "what such utter total solch solche quel quelle espèce qué vaya menudo menuda",
}
_WORDS = {w: symbol for symbol, words in LEXICON.items() for w in words.split()}
_CORE = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:,¶|]")


class Transducer:
    """Deterministic weighted transducer over symbols; symbols without an arc pass unchanged and keep the state.

    An arc gives the next state, the symbol written, a factor on the weight of
    the word and a bonus. In ``window`` states a symbol without an arc leads to
    the given state instead.
    """

    def __init__(self, arcs: dict[tuple[int, int], tuple[int, int, float, float]], falls: dict[int, int] | None = None):
        self.arcs, self.falls = arcs, falls or {}

    def step(self, state, symbol: int):
        found = self.arcs.get((state, symbol))
        return found or (self.falls.get(state, state), symbol, 1.0, 0.0)

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: this one's output is read by ``other``; factors multiply, bonuses add."""
        arcs, number, queue = {}, {(0, 0): 0}, [(0, 0)]
        for pair in queue:
            for symbol in SYMBOLS:
                a, middle, f, x = self.step(pair[0], symbol)
                b, out, g, y = other.step(pair[1], middle)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    queue.append((a, b))
                arcs[number[pair], symbol] = (number[a, b], out, f * g, x * g + y)
        return Transducer(arcs)


def grammar() -> Transducer:
    """Negation, then reported speech, then threats, then insults, then targets."""
    # A negation weakens an insult or a threat among the two words after it.
    negation = Transducer({
        **{(s, NEGATION): (2, OTHER, 1.0, 0.0) for s in range(3)},
        **{(s, x): (s - 1, x, 0.25, 0.0) for s in (1, 2) for x in (INSULT, THREAT)},
    }, {2: 1, 1: 0})
    # After a verb of saying the rest of the clause is somebody else's.
    reported = Transducer({
        **{(s, REPORT): (1, OTHER, 1.0, 0.0) for s in (0, 1)},
        **{(1, x): (1, x, 0.4, 0.0) for x in (INSULT, THREAT)},
    })
    # A threat needs an intent before it; without one the word says little.
    threat = Transducer({
        **{(s, INTENT): (1, OTHER, 1.0, 0.0) for s in (0, 1)},
        (0, THREAT): (0, OTHER, 0.0, 0.0), (1, THREAT): (1, THREAT, 1.0, 0.5),
    })
    # An insult needs a target before it (state 1), another insult (2) or an opening up to two words before (3, 4);
    # a target behind a lone one makes up for what that lost.
    insult = Transducer({
        **{(s, TARGET): (1, TARGET, 1.0, 0.0) for s in (0, 3, 4)}, (2, TARGET): (1, TARGET, 1.0, _AIMED_LATE),
        (0, INSULT): (2, INSULT, _LONE, 0.0), (1, INSULT): (1, INSULT, 1.0, 0.0),
        **{(s, INSULT): (2, INSULT, 1.0, 0.0) for s in (2, 3, 4)}, **{(s, OPENING): (3, OTHER, 1.0, 0.0) for s in (0, 3, 4)},
    }, {3: 4, 4: 0})
    # A target in the clause sharpens what it meets, before or after.
    target = Transducer({
        (0, TARGET): (1, OTHER, 1.0, 0.0), (1, TARGET): (1, OTHER, 1.0, 0.0), (2, TARGET): (1, TARGET, 1.0, 1.0),
        **{(0, x): (2, x, 1.0, 0.0) for x in (INSULT, THREAT)}, **{(2, x): (2, x, 1.0, 0.0) for x in (INSULT, THREAT)},
        **{(1, x): (1, x, 1.0, 1.0) for x in (INSULT, THREAT)},
    })
    return negation.then(reported).then(threat).then(insult).then(target)


def core(chunk: str) -> str:
    """Letters of a chunk of one run, lower-cased."""
    m = _CORE.search(chunk)
    return m.group().lower().replace("’", "'") if m else ""


def runs_of(chunk: str) -> list[str]:
    """A chunk cut before each of its runs of letters but the first, so that every part holds one run at most."""
    if chunk.isalpha():
        return [chunk]
    starts = [m.start() for m in _CORE.finditer(chunk)]
    return [chunk[a:b] for a, b in zip([0, *starts[1:]], [*starts[1:], None])]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def stems(word: str) -> list[str]:
    """The word itself and its beginnings, which end in ``*``."""
    return [word, *(word[:n] + "*" for n in STEM_LENGTHS if len(word) > n)] if word else []


class Words:
    """Text as words with clause ends: arrays over the distinct chunks of a batch.

    A chunk is what white space separates, cut into its runs of letters;
    ``joined`` marks those that follow the one before without white space.
    """

    def __init__(self, texts: pa.Array):
        lines = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " ¶ ")
        lists = pc.ascii_split_whitespace(lines)
        coded = lists.flatten().dictionary_encode()
        names: dict[str, int] = {}
        cut = [[names.setdefault(r, len(names)) for r in runs_of(c)] for c in coded.dictionary.to_pylist()]
        self.chunks: list[str] = list(names)
        sizes = np.array([len(x) for x in cut], np.int64)
        flat = np.array([i for x in cut for i in x], np.int32)
        whole = coded.indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes[whole])])
        self.at = flat[_spread((np.cumsum(sizes) - sizes)[whole], sizes[whole])]
        self.joined = np.ones(len(self.at), bool)
        self.joined[starts[:-1]] = False
        self.offsets = starts[lists.offsets.to_numpy()]
        self.row = np.repeat(np.arange(len(lists)), np.diff(self.offsets))

    def text(self, first: int, last: int) -> str:
        """The words from ``first`` to ``last``, as they are joined."""
        return "".join(("" if self.joined[i] else " ") + self.chunks[self.at[i]] for i in range(first, last + 1)).removeprefix(" ")


# Symbols of chunks, by model, that a worker has worked out.
_SEEN: dict[int, dict[str, tuple[int, float, bool]]] = {}
remember("toxicity", _SEEN.clear)


@dataclass
class Toxicity:
    """Weights of learned stems, and the curve from evidence to score."""

    stems: dict[str, float]
    slope: float = 1.0
    offset: float = -4.0

    def __post_init__(self):
        self.machine = grammar()
        self._key = hash(frozenset(self.stems.items()))

    def symbol(self, chunk: str) -> tuple[int, float, bool]:
        """Symbol and weight of a chunk, and whether a clause ends with it."""
        seen = _SEEN.setdefault(self._key, {})
        if chunk not in seen:
            if len(seen) > 150_000:
                seen.clear()
            word = core(chunk)
            kind = _WORDS.get(word, OTHER)
            learned = max((self.stems[s] for s in stems(word) if s in self.stems), default=0.0)
            if kind == OTHER and learned:
                kind = INSULT
            weight = max(learned, _SEED_WEIGHT) if kind in (INSULT, THREAT) else 0.0
            if kind == INSULT and word not in _WORDS:
                weight = learned
            seen[chunk] = (kind, weight, bool(_CLAUSE_END.search(chunk)))
        return seen[chunk]

    def clause(self, symbols: list[tuple[int, float]]) -> float:
        """Weight of one clause."""
        state, total = 0, 0.0
        for symbol, weight in symbols:
            state, out, factor, bonus = self.machine.step(state, symbol)
            if out in (INSULT, THREAT):
                total += weight * factor + bonus * factor
            elif out == TARGET:
                total += bonus
        return total

    def matches(self, texts: pa.Array) -> list[tuple[int, str, float]]:
        """Row, text and weight of each matched clause, in order."""
        begin("toxicity")
        words = Words(texts)
        known = [self.symbol(c) for c in words.chunks]
        kind = np.array([k[0] for k in known], np.int8)[words.at]
        ends = np.array([k[2] for k in known], bool)[words.at]
        found = []
        done = -1
        for i in np.flatnonzero((kind == INSULT) | (kind == THREAT)).tolist():
            if i <= done:
                continue
            first, last = int(words.offsets[words.row[i]]), int(words.offsets[words.row[i] + 1]) - 1
            a = i
            while a > first and not ends[a - 1]:
                a -= 1
            done = i
            while done < last and not ends[done]:
                done += 1
            weight = self.clause([(known[w][0], known[w][1]) for w in words.at[a : done + 1].tolist()])
            if weight > 0:
                found.append((int(words.row[i]), words.text(a, done), weight))
        return found

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Evidence of each text, worked out in pieces that keep the arrays small."""
        return np.concatenate([np.zeros(0), *(self._evidence(piece) for piece in runs(texts, 2 << 20))])

    def _evidence(self, texts: pa.Array) -> np.ndarray:
        total = np.zeros(len(texts))
        for row, _, weight in self.matches(texts):
            total[row] += weight
        # Further clauses say less and less that is new.
        return np.log1p(total)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.offset, -50, 50)))


def _stem_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Documents of each class that hold a stem, summed over the pieces of a batch."""
    begin("toxicity")
    found, at = [], 0
    for piece in runs(batch.column("text"), 4 << 20):
        found.append(_piece_counts(piece, batch.column("label").slice(at, len(piece)).to_numpy(zero_copy_only=False) > 0))
        at += len(piece)
    return pa.concat_batches(found)


def _piece_counts(texts: pa.Array, label: np.ndarray) -> pa.RecordBatch:
    words = Words(texts)
    names: dict[str, int] = {}
    listed = [[names.setdefault(s, len(names)) for s in stems(core(c))] for c in words.chunks]
    sizes = np.array([len(x) for x in listed], np.int64)
    flat = np.array([i for x in listed for i in x], np.int64)
    starts = np.cumsum(sizes) - sizes
    pairs = np.unique(words.row.astype(np.int64) * len(words.chunks) + words.at)
    row, chunk = pairs // max(len(words.chunks), 1), pairs % max(len(words.chunks), 1)
    n = sizes[chunk]
    pairs = np.unique(np.repeat(row, n) * max(len(names), 1) + flat[_spread(starts[chunk], n)])
    stem, toxic = pairs % max(len(names), 1), label[pairs // max(len(names), 1)]
    both = [np.bincount(stem[toxic == t], minlength=len(names)) for t in (True, False)]
    return pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), *(pa.array(b, pa.int64()) for b in both)], names=["stem", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> Toxicity:
    """Learn stems and the curve from about ``rows`` labelled documents that are not held out.

    A stem counts when it is far more frequent among toxic rows and follows
    several different words there, so a group of copies of one text teaches
    nothing. Counts are summed by stem before they are shuffled; the driver gets
    the stems that pass and one number per sampled row.
    """
    sample = labelled(docs, labels, label, rows)
    classes = sample.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()
    sizes = {bool(r.label > 0): r.n for r in classes}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Toxicity({})
    counts = map_arrow(sample, _stem_counts, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counts.where((F.col("toxic") >= LEAST_DOCS) & ((F.col("toxic") / n_toxic) > LEAST_RATIO * (F.col("clean") + 0.5) / n_clean))
    likely = {r.stem: (r.toxic, r.clean) for r in strong.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(likely))

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        held = [[s for s in stems(core(c)) if s in shared.value] for c in words.chunks]
        some = np.array([bool(h) for h in held], bool)
        found = set()
        for i in np.flatnonzero(some[words.at] if len(words.at) else []).tolist():
            first = i == words.offsets[words.row[i]]
            left = "" if first else words.chunks[words.at[i - 1]]
            found.update((s, left) for s in held[words.at[i]])
        found = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["stem", "left"])

    spread = map_arrow(sample.where("label > 0"), contexts, "stem string, left string").groupBy("stem").agg(F.countDistinct("left").alias("n"))
    wide = {r.stem for r in spread.where(F.col("n") >= LEAST_CONTEXTS).collect()}
    # A beginning that clean words share, and that one longer stem explains, is left to that stem.
    for s in [s for s in wide if s[-1] == "*" and likely[s][1]]:
        if any(e != s and e.startswith(s[:-1]) and likely[e][0] >= 0.8 * likely[s][0] and likely[e][1] < likely[s][1] for e in likely):
            wide.discard(s)
    weights = {s: float(np.log((t + 0.5) / n_toxic) - np.log((c + 0.5) / n_clean)) for s, (t, c) in likely.items() if s in wide}
    model = docs.sparkSession.sparkContext.broadcast(Toxicity(weights))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(model.value.evidence(batch.column("text")), pa.float64())], names=["doc_id", "label", "evidence"])

    seen = map_arrow(sample, weigh, "doc_id long, label int, evidence double").groupBy("doc_id", "label").agg(F.max("evidence").alias("evidence")).orderBy("doc_id").collect()
    curve = logistic_curve(np.array([r.evidence for r in seen]), np.where(np.array([r.label for r in seen]) > 0, 1.0, -1.0))
    return Toxicity(weights, *curve) if curve[0] > 0 else Toxicity(weights)


def score(docs: DataFrame, model: Toxicity, into: str = "score") -> DataFrame:
    """All columns of ``docs`` with the probability of being toxic in column ``into``; no shuffle. The model is broadcast."""
    return score_column(docs, model, into)


def matched_clauses(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``doc_id``, ``clause`` and ``weight`` of each clause that the grammar matches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.matches(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        return pa.RecordBatch.from_arrays([
            pa.array([ids[r] for r, _, _ in found], pa.int64()), pa.array([c for _, c, _ in found], pa.string()),
            pa.array([w for _, _, w in found], pa.float64()),
        ], names=["doc_id", "clause", "weight"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_arrow(texts, run, "doc_id long, clause string, weight double")
