"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities and rates of the whole text: words of a fixed lexicon and words that begin with
one of the stems learnt from the training labels (plainly written, or behind look-alike characters, stretched letters or inner
punctuation), second-person words near a lexicon word, capitals, punctuation, and obfuscated spellings.
The labels, language, source and doc_id are not among them.

Training reads about SAMPLE labelled documents (those with the smallest hashes of doc_id; all, if there
are fewer), of which a quarter calibrates; every document is scored on its whole text.

Defined results: null and empty texts are scored as a text without words; a doc_id that is null or has
no label isn't trained on; a document with several labels counts as toxic if any of them is 1; equal
rows get equal scores; without any labels every score is 0; only doc_id, text and the named label
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duochron.llm.boosting import Isotonic, Trees
from duochron.llm.common import arrow_map, stage, texts, unstage

#: The expected number of labelled documents that training reads, whatever the corpus.
SAMPLE = 12_000
#: A learnt stem (the first STEMS characters of words, or less) is in at least this share of toxic training
#: documents, and this many times likelier there.
SHARE, LIFT, LEARNT, STEMS = 0.03, 20.0, 200, range(3, 10)

#: Insults and slurs' milder kin that mark abuse in English.
LEXICON = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool fools imbecile dimwit jerk creep freak filth vermin hate kill die ugly retard bastard bitch crap damn shit fuck fucking asshole dick slut whore pig coward liar scumbag lowlife degenerate".split())
#: Words that address somebody.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre du dich dir ihr dein usted ustedes ti".split())

_LOOKALIKE = str.maketrans("013457@$!|", "oleastasil")
_WORD = re.compile(r"[^\W_]+")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_-][^\W\d_]){2,}(?![^\W_])")
_STRETCH = re.compile(r"(.)\1{2,}")
_LETTERS = re.compile(r"[\W\d_]+")
_SHOUT = re.compile("[A-Z\u00c0-\u00de]{3}")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_CAPITALS = bytes(range(65, 91))
_ENDS = ".,;:!?|()\"'"
NEAR = 5


def features(text: str, learnt: frozenset[str], lengths: tuple[int, ...] = ()) -> list[float]:
    """lengths: those of the learnt stems."""
    small = text.lower()
    low = _WORD.findall(small)
    n = max(1, len(low))
    known = set(low)
    fixed_here, learnt_here = known & LEXICON, set()
    for k in lengths:
        if not learnt.isdisjoint({w[:k] for w in known}):
            learnt_here.update(w for w in known if w[:k] in learnt)
    at = [i for i, w in enumerate(low) if w in fixed_here or w in learnt_here] if fixed_here or learnt_here else []
    fixed = sum(low[i] in fixed_here for i in at)
    taught = sum(low[i] in learnt_here for i in at)
    both = LEXICON | learnt
    masks = [w for w in small.split() if not w.isalpha() and not w.strip(_ENDS).isalpha() and any(map(str.isalpha, w))]
    singles = [i for i, w in enumerate(low) if len(w) == 1]
    if any(a + 2 == b for a, b in zip(singles, singles[2:], strict=False)):
        masks += _SPACED.findall(small)
    plain = [_LETTERS.sub("", w.strip(_ENDS).translate(_LOOKALIKE)) for w in masks]
    hidden = sum(w in both or _STRETCH.sub(r"\1", w) in both for w in plain)
    stretched = [w for w in low if len(w) > 4 and _STRETCH.search(w)] if any(t in small for t in _TRIPLES) else []
    hidden += sum(_STRETCH.sub(r"\1", w) in both or _STRETCH.sub(r"\1\1", w) in both for w in stretched if w not in both)
    near = sum(any(low[j] in SECOND_PERSON for j in range(max(0, i - NEAR), min(len(low), i + NEAR + 1))) for i in at)
    chars = max(1, len(text))
    data = text.encode()
    shouted = sum(len(w) > 2 and w.isupper() for w in _WORD.findall(text)) if _SHOUT.search(text) else 0
    you = known & SECOND_PERSON
    return [
        float(fixed), fixed / n, float(taught), taught / n, float(len(fixed_here | learnt_here)), float(hidden), hidden / n,
        near / n, float(near), sum(map(low.count, you)) / n, shouted / n, (len(data) - len(data.translate(None, _CAPITALS))) / chars, text.count("!") / chars, text.count("?") / chars,
        sum(map(text.count, ".,;:")) / chars, sum(map(text.count, "*#$%@&")) / chars, len(masks) / n, len(stretched) / n, float(np.log1p(len(low))),
    ]


WIDTH = len(features("", frozenset()))


def stem_lengths(learnt: frozenset[str]) -> tuple[int, ...]:
    return tuple(sorted({len(s) for s in learnt}))


class Model:
    def __init__(self, learnt: frozenset[str], trees: Trees | None, steps: Isotonic | None):
        self.learnt, self.trees, self.steps = learnt, trees, steps
        self.lengths = stem_lengths(learnt)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        return np.clip(self.steps(self.trees.raw(np.array([features(t, self.learnt, self.lengths) for t in texts]).reshape(-1, WIDTH))), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train=None, sample: int = SAMPLE) -> Model:
    """``train``: a condition on doc_id (a column expression) that training rows meet."""
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if train is not None:
        named = named.where(train)
    every = named.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, sample / max(1, every.count()))  # by hash, so nothing is sorted or gathered
    few = every.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = stage(texts(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")), "labelled")  # about `sample` ids
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)) == 0

    def words():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                kept = [(w, y) for t, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True) for w in {w[:k] for w in {w.lower() for w in _WORD.findall(t)} for k in STEMS if len(w) >= k}]
                yield {"word": [w for w, _ in kept], "y": [y for _, y in kept]}

        return run

    fitting = chosen.where(~fold)
    n1, n0 = fitting.agg(F.sum(F.col("y")), F.sum(1 - F.col("y"))).first()
    n1, n0 = n1 or 0, n0 or 0
    if not n1 or not n0:
        unstage(chosen)
        return Model(frozenset(), None, None)
    found = arrow_map(fitting.select("text", "y"), words, "word string, y int").groupBy("word").agg(F.sum("y").alias("in1"), F.sum(1 - F.col("y")).alias("in0"))
    found = found.where((F.col("in1") >= max(3, SHARE * n1)) & (F.col("in1") / n1 >= LIFT * (F.col("in0") + 1) / n0)).orderBy(F.desc("in1"), "word").limit(LEARNT)
    stems = {r[0] for r in found.collect()}
    learnt = frozenset(s for s in stems if not any(s[:k] in stems for k in range(STEMS[0], len(s))))  # a shorter stem says it all
    lengths = stem_lengths(learnt)

    def dense():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                yield {"x": [features(t, learnt, lengths) for t in b["text"].to_pylist()], "y": b["y"], "held": b["held"]}

        return run

    rows = arrow_map(chosen.select("text", "y", fold.alias("held")), dense, "x array<double>, y int, held boolean").collect()  # about `sample` rows
    x, y, held = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], bool)
    unstage(chosen)
    trees = Trees().fit(x[~held], y[~held])
    check = held if y[held].size and 0 < y[held].mean() < 1 else np.ones(len(y), bool)
    return Model(learnt, trees, Isotonic().fit(trees.raw(x[check]), y[check]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                yield {"doc_id": b["doc_id"], "score": model.score(b["text"].to_pylist())}

        return run

    return arrow_map(texts(docs), make, "doc_id bigint, score double")


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores below ``threshold``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def make():
        def run(batches) -> Iterator[dict]:
            for b in batches:
                keep = model.score([t or "" for t in b["text"].to_pylist()]) < threshold
                yield {k: v.take(np.flatnonzero(keep)) for k, v in b.items()}

        return run

    return arrow_map(docs, make, fields)
