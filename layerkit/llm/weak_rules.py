"""Operator 8: quality rules by weak supervision.

Each rule votes good or bad on a text, or abstains. Expectation-maximisation
over the counts of vote patterns estimates how each rule votes on good and on
bad texts, without labels, and a text is kept by its posterior probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from layerkit.llm.common import map_arrow
from layerkit.session import stage

GOOD, BAD, NONE = 1, 0, 2
# Votes (bad, good) that a rule is taken to have cast on bad and on good texts before any is seen.
PRIOR = np.array([[10.0, 10.0], [0.5, 20.0]])

# Function words of the languages that the corpus holds, few of each.
COMMON = frozenset("""the of and to in a is that it for was with on as be by at from
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine
    de la le les et des en un une du que dans qui pour par est au
    el los las y por con del se una su para como más""".split())

# Columns of :func:`measure`, all counted over the whole text.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_common", "n_distinct", "n_sentence_ends",
)


def _repeats(codes: np.ndarray, width: int = 3) -> int:
    """Words in windows of ``width`` words that are found twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    _, keys = np.unique(codes, return_inverse=True)
    key = keys[:n].astype(np.int64)
    for i in range(1, width):  # windows are numbered anew at each step, so keys stay small
        _, key = np.unique(key * len(codes) + keys[i : n + i], return_inverse=True)
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(codes), bool)
    for i in range(width):
        covered[i : n + i] |= again
    return int(covered.sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """:data:`MEASURES` of each text; a null text has no word and all counts zero."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    coded = lists.flatten().dictionary_encode()
    codes, offsets = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    names = coded.dictionary
    known = np.array([w.strip(".,;:!?\"'()").lower() in COMMON for w in names.to_pylist()], bool)
    ends = pc.match_substring_regex(names, r"[.!?…][\"'”»)]*$").to_numpy(zero_copy_only=False).astype(bool)
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.utf8_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {m: np.zeros(len(raw), np.int64) for m in MEASURES}
    out["n_words"] = np.where(blank, 0, np.diff(offsets))
    out["word_chars"] = chars - count(r"[\x20\x09-\x0D]")
    out["n_symbols"] = count(r"[#*$%&|<>]")
    out["n_upper"], out["n_letters"] = count(r"\p{Lu}"), count(r"\p{L}")
    for i, text in enumerate(raw):
        if blank[i]:
            continue
        own = codes[offsets[i] : offsets[i + 1]]
        out["n_repeat_words"][i] = _repeats(own)
        out["n_distinct"][i] = len(np.unique(own))
        out["n_common"][i] = int(known[own].sum())
        out["n_sentence_ends"][i] = int(ends[own].sum())
        out["n_dup_lines"][i] = _dup_lines(text)
        out["n_lines"][i] = text.count(b"\n") + 1
    return out


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and the measures of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["doc_id", *MEASURES])

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(texts, run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def vote(bad: Column, good: Column) -> Column:
    """A rule: bad, else good, else no vote. A condition that is null does not hold."""
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def rules() -> dict[str, Column]:
    """The votes, as columns over the measures."""
    words, letters = F.greatest("n_words", F.lit(1)), F.greatest("n_letters", F.lit(1))
    c = F.col
    return {
        "enough_words": vote(c("n_words") < 50, c("n_words") >= 100),
        "few_symbols": vote(c("n_symbols") / F.greatest("word_chars", F.lit(1)) > 0.04, c("n_symbols") * 200 < c("word_chars")),
        "mixed_case": vote(c("n_upper") / letters > 0.4, c("n_upper") / letters < 0.15),
        "word_length": vote((c("word_chars") / words > 12) | (c("word_chars") / words < 2.5), (c("word_chars") / words).between(3, 9)),
        "new_lines": vote(c("n_dup_lines") / F.greatest("n_lines", F.lit(1)) > 0.4, c("n_dup_lines") == 0),
        "new_phrases": vote(c("n_repeat_words") / words > 0.45, c("n_repeat_words") / words < 0.05),
        "common_words": vote(c("n_common") / words < 0.05, c("n_common") / words > 0.12),
        "sentences": vote(c("n_sentence_ends") / words < 0.01, (c("n_sentence_ends") / words).between(0.02, 0.4)),
        "vocabulary": vote(c("n_distinct") / words < 0.15, c("n_distinct") / words > 0.4),
    }


@dataclass
class LabelModel:
    """Share of good texts, and the probability of each vote of each rule, if it votes, on bad and on good texts."""

    good: float
    votes: np.ndarray  # rule, class (bad, good), vote (bad, good, none); none counts 1

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being good for each row of votes."""
        logs = np.log(self.votes)
        both = np.stack([np.full(len(patterns), np.log(p)) for p in (1 - self.good, self.good)], axis=1)
        for j in range(patterns.shape[1]):
            both += logs[j][:, patterns[:, j]].T
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))


def fit_patterns(patterns: np.ndarray, counts: np.ndarray, steps: int = 200, tolerance: float = 1e-7) -> LabelModel:
    """Expectation-maximisation from the majority vote on.

    A rule is held to be better than chance: what it votes bad is at least as
    likely among the bad. :data:`PRIOR` keeps every probability off zero.
    """
    n_rules = patterns.shape[1]
    if not len(patterns):
        return LabelModel(0.5, np.ones((n_rules, 2, 3)))
    bad, good = (patterns == BAD).sum(axis=1), (patterns == GOOD).sum(axis=1)
    # One rule that says bad may well be right where most rules can only say good.
    p = np.select([bad > 1, bad > 0, good > 0], [0.1, 0.4, 0.95], 0.5)
    total = counts.sum()
    model = None
    for _ in range(steps):
        before = p
        weight = np.stack([counts * (1 - p), counts * p], axis=1)
        votes = np.zeros((n_rules, 2, 3))
        for j in range(n_rules):
            for v in (BAD, GOOD, NONE):
                votes[j, :, v] = weight[patterns[:, j] == v].sum(axis=0)
        votes = votes[:, :, :NONE] + PRIOR
        votes /= votes.sum(axis=2, keepdims=True)
        wrong = votes[:, 1, BAD] > votes[:, 0, BAD]
        votes[wrong] = votes[wrong].mean(axis=1, keepdims=True)
        # Abstaining says nothing about the class.
        votes = np.concatenate([votes, np.ones((n_rules, 2, 1))], axis=2)
        share = float(np.clip((weight[:, 1].sum() + 1) / (total + 2), 0.02, 0.98))
        model = LabelModel(share, votes)
        p = model.posterior(patterns)
        if np.abs(p - before).max() < tolerance:
            break
    return model


def judge(docs: DataFrame, least: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measures, votes, base verdict, posterior ``quality`` and ``kept`` of every row.

    ``base_failed`` is a text of fewer than 50 words, or with more than half of
    its words in repeated windows; such a text is never kept. The others are kept
    from a posterior of ``least`` on. Texts are read once; the votes of all rows
    are counted by pattern (3 ** rules at most), and these counts go to the driver.
    """
    votes = rules()
    rows = stage(measured(docs, id_column, text_column).withColumns(votes), "measures")
    counted = rows.groupBy(*votes).agg(F.count("*").alias("n")).collect()
    patterns = np.array([[r[v] for v in votes] for r in counted], np.int64).reshape(-1, len(votes))
    model = fit_patterns(patterns, np.array([r.n for r in counted], np.float64))
    logs = np.log(model.votes)
    odds = F.lit(float(np.log(model.good / (1 - model.good))))
    for j, name in enumerate(votes):
        weigh = F.lit(0.0)
        for v in (BAD, GOOD, NONE):
            weigh = F.when(F.col(name) == v, float(logs[j, 1, v] - logs[j, 0, v])).otherwise(weigh)
        odds = odds + weigh
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= least)
    )
