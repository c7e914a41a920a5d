"""Toxicity by weak supervision: many voters, a generative label model over them, a linear classifier on its posteriors.

*Voters.* Word lists of insults by language, the same written with digits for letters, how dense the hits are, and terms
mined from the labelled training texts (whole words, word beginnings, character sequences), dealt by a hash into two voters per kind,
so that they make different errors. A voter says 1 or nothing; one says 0 for texts with words of which no list knows any; the
annotator's label of a training text is a voter with given error rates, which tells the model which class is which.

*Label model.* The votes of all training documents are counted by pattern. The voters of a pattern are independent given the unknown class, but for
groups that are correlated beyond that: a group is one voter with a joint table. The tables (accuracies and coverage) and the class
rate are fitted by expectation maximisation; the pairs whose counts depart most from what the fitted model expects join a group, and the
model is fitted again until none departs. There are at most ``2 ** len(VOTERS) * 3`` patterns whatever the corpus, so the driver holds a few thousand counts.

*Classifier.* A logistic regression on hit counts, densities and single mined terms, fitted to the posterior labels of a bounded
sample of training documents. Labels, language, source and id are no inputs of a score.

Bounds: terms are mined from at most ``MAX_TRAINING`` labelled texts and the classifier is fitted on as many (smallest hashes of the id); at most
``MAX_TERMS`` mined terms are kept (largest lower bound of their precision). The votes of the label model are those of all training documents.

Defined cases: null text counts as empty and gets a score like any other; null labels are ignored, several of an id are averaged; a
null id belongs to the training rows and has no label; without any label there are no mined terms and the word lists
alone decide; repeated rows are scored one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import bounded_sample, read, small_batches, some, stored, text_of

MAX_TRAINING, MAX_TERMS, PREDICTED_FROM = 20000, 1500, 0.7
LEAST_TEXTS, LEAST_PRECISION = 6, 0.6
# How an annotator is taken to err: the share of texts that get label 1 in class 0 and in class 1.
ANNOTATOR = (0.01, 0.95)
LEAST_LABELS = 50  # below, the label model is not fitted further than its start
START_SIZES, INNER_SIZES = range(4, 9), range(5, 8)

# Insults by language, general knowledge, not taken from any label.
LEXICON = {
    "en": "idiot idiots moron morons stupid dumb dumbass loser losers scum trash pathetic worthless disgusting clown imbecile jerk"
    " bastard bitch asshole shit bullshit fuck fucking fucker crap retard freak filth filthy vermin pig swine coward liar ugly slut whore",
    "de": "idiot idioten dumm dummkopf trottel arschloch scheisse scheiße versager abschaum widerlich wertlos erbärmlich schwein hurensohn"
    " drecksack vollidiot schlampe miststück ekelhaft",
    "fr": "idiot idiote imbécile connard connasse salaud salope crétin débile merde ordure abruti pathétique dégoûtant minable raclure putain enculé",
    "es": "idiota imbécil estúpido estúpida tonto gilipollas cabrón mierda basura escoria patético asqueroso perdedor inútil puta pendejo payaso",
}
_DIGITS = str.maketrans("013457@$!", "oieastasi")
_PLAIN = re.compile(r"[\W_]+")
_MIXED = re.compile(r"[\w@$!]+")

KINDS = ["lexicon_en", "lexicon_other", "disguised", "word_a", "word_b", "start_a", "start_b", "inner_a", "inner_b"]
VOTERS = [*KINDS, "dense", "several", "none"]
N_GROUP_FEATURES = 2 * len(KINDS) + 4
NAMES = ["n_words", "votes", "groups", "terms"]


# ---- Terms --------------------------------------------------------------------------------------
def normal(text: str) -> str:
    """Lower case words with one space before and after each."""
    return " " + _PLAIN.sub(" ", text.lower()).strip() + " "


def terms_of(text: str) -> set[str]:
    """Whole words (space on both sides), word beginnings (space before) and character sequences within words."""
    found = set()
    for word in set(normal(text).split()):
        found.add(f" {word} ")
        found.update(" " + word[:k] for k in START_SIZES if len(word) >= k)
        found.update(word[i : i + k] for k in INNER_SIZES for i in range(1, len(word) - k + 1))
    return found


def kind_of(term: str) -> str:
    kind = "word" if term.endswith(" ") else "start" if term.startswith(" ") else "inner"
    return f"{kind}_{'ab'[sum(term.encode()) % 2]}"


def mined_terms(sample: DataFrame, least_texts: int = LEAST_TEXTS, least_precision: float = LEAST_PRECISION, most: int = MAX_TERMS) -> list[str]:
    """Terms of (body, label) rows that mostly stand in texts with label 1: those whose precision has the largest lower bounds.
    Tasks add up their own counts first; what comes to the driver is bounded as the rows are."""

    def counted(rows: DataFrame, among: frozenset[str] | None = None) -> DataFrame:
        def count(batches):
            held = Counter()
            for batch in batches:
                for body in batch["body"]:
                    found = terms_of(body)
                    held.update(found if among is None else found & among)
                if len(held) > 500_000:
                    yield from some(list(held.items()), ["term", "n"])
                    held = Counter()
            yield from some(list(held.items()), ["term", "n"])

        per_task = rows.select("body").mapInPandas(count, "term string, n long")
        return per_task.groupBy("term").agg(F.sum("n").alias("n"))

    hits = {r.term: r.n for r in counted(sample.where("label >= 0.5")).where(F.col("n") >= least_texts).collect()}
    others = {r.term: r.n for r in counted(sample.where("label < 0.5"), frozenset(hits)).collect()} if hits else {}

    def bound(term: str) -> float:
        """Wilson's lower bound of the precision, two deviations."""
        n = hits[term] + others.get(term, 0)
        p = hits[term] / n
        return (p + 2 / n - 2 * (p * (1 - p) / n + 1 / n**2) ** 0.5) / (1 + 4 / n)

    ranked = sorted((-bound(t), len(t), t) for t in hits)
    return [t for b, _, t in ranked if -b >= least_precision][:most]


class Matcher:
    """Counts the terms of texts by kind, in one pass of an Aho-Corasick automaton over each."""

    def __init__(self, mined: list[str]) -> None:
        self.mined = mined
        kinds = {f" {w} ": "lexicon_en" if lang == "en" else "lexicon_other" for lang in reversed(LEXICON) for w in LEXICON[lang].split()}
        self.insults = {t.strip() for t in kinds}
        self.searcher = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for term, kind in kinds.items():
            found.setdefault(term, []).append((KINDS.index(kind), -1))
        for i, term in enumerate(mined):
            found.setdefault(term, []).append((KINDS.index(kind_of(term)), i))
        for term, uses in found.items():
            self.searcher.add_word(term, uses)
        self.searcher.make_automaton()

    def __call__(self, text: str) -> tuple[int, int, list[float], list[int]]:
        """(words, votes as bits, features of the groups, numbers of the mined terms found)."""
        plain = normal(text)
        n_words = plain.count(" ") - 1 if len(plain) > 2 else 0
        hits, kinds, terms, ends = [0] * len(KINDS), [set() for _ in KINDS], set(), set()
        for end, uses in self.searcher.iter(plain):
            for kind, term in uses:
                hits[kind] += 1
                kinds[kind].add(term if term >= 0 else end)
                if term >= 0:
                    terms.add(term)
            ends.add(plain.rfind(" ", 0, end) if plain[end] == " " else plain.rfind(" ", 0, end + 1))
        disguised = sum(not m.isalpha() and m.lower().translate(_DIGITS) in self.insults for m in _MIXED.findall(text))
        hits[KINDS.index("disguised")] = disguised
        marked = len(ends) + disguised
        dense, several = marked > 0 and 100 * marked >= n_words, marked >= 3
        votes = [h > 0 for h in hits] + [dense, several, n_words > 0 and not marked]
        share = 100 / max(n_words, 20)
        groups = [np.log1p(h) for h in hits] + [min(h * share, 20.0) for h in hits]
        groups += [np.log1p(marked), min(marked * share, 20.0), float(marked > 0), np.log1p(sum(map(len, kinds)))]
        return n_words, sum(1 << i for i, v in enumerate(votes) if v), groups, sorted(terms)


# ---- Label model --------------------------------------------------------------------------------
class LabelModel:
    """A latent class with voters that are independent given it, but for groups with a joint table.

    Patterns are rows of outcomes (one column per voter) with counts. ``groups`` lists the columns of each group; the tables hold the
    probability of each joint outcome for both classes. ``none`` is the column of a voter for class 0, if there is one."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, annotator: int, none: int | None = None, rounds: int = 200, most_in_group: int = 6) -> None:
        self.patterns, self.counts, self.most = patterns, counts.astype(float), most_in_group
        self.groups = [[j] for j in range(patterns.shape[1])]
        self.annotator = annotator
        # The fit begins from the annotator's labels, else from whether any voter says 1.
        labelled = patterns[:, annotator]
        any_vote = (np.delete(patterns, [j for j in (annotator, none) if j is not None], axis=1) > 0).any(1)
        self.start = np.where(labelled == 1, 0.9, np.where(any_vote, 0.7, 0.01))
        # With too few labels nothing tells which class is which: the votes are weighed once, as the start saw them.
        enough = self.counts[labelled > 0].sum() >= LEAST_LABELS
        while True:
            self._fit(rounds if enough else 1)
            pair = self._most_correlated() if enough else None
            if pair is None:
                break
            a, b = pair
            self.groups = [g for g in self.groups if g not in (a, b)] + [a + b]

    def _codes(self, group: list[int]) -> np.ndarray:
        code = np.zeros(len(self.patterns), dtype=np.int64)
        for j in group:
            code = 4 * code + self.patterns[:, j]
        return code

    def _fit(self, rounds: int) -> None:
        codes = [np.unique(self._codes(g), return_inverse=True) for g in self.groups]
        q, n = self.start.copy(), self.counts
        for _ in range(rounds):
            self.rate = float(np.clip((q * n).sum() / max(n.sum(), 1), 1e-4, 0.5))
            odds = np.full(len(n), np.log(self.rate / (1 - self.rate)))
            self.tables = []
            for group, (values, code) in zip(self.groups, codes, strict=True):
                # A few documents as the start saw them keep the classes from changing places where data are few.
                first = [np.bincount(code, w * n, len(values)) + 0.1 for w in (1 - self.start, self.start)]
                table = np.array([np.bincount(code, w * n, len(values)) + 20 * f / f.sum() for w, f in zip((1 - q, q), first, strict=True)])
                if group == [self.annotator]:
                    # Whether a text has a label says nothing about its class.
                    table = np.array([np.where(values == 1, share, np.where(values == 2, 1 - share, 1.0)) for share in ANNOTATOR])
                    self.tables.append(dict(zip(values.tolist(), table.T, strict=True)))
                    odds += np.log(table[1] / table[0])[code]
                    continue
                table /= table.sum(1, keepdims=True)
                self.tables.append(dict(zip(values.tolist(), table.T, strict=True)))
                odds += np.log(table[1] / table[0])[code]
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            done = np.abs(new - q).max(initial=0) < 1e-7
            q = new
            if done:
                break
        self.posterior = q

    def _most_correlated(self) -> tuple[list[int], list[int]] | None:
        """The two groups whose joint counts within the classes depart most from independence, if that is more than chance
        and a correlation worth a table of its own."""
        best, chosen = 0.1, None
        n, q = self.counts, self.posterior
        for x, a in enumerate(self.groups):
            for b in self.groups[x + 1 :]:
                if len(a) + len(b) > self.most or self.annotator in a + b:
                    continue
                (u, i), (v, j) = (np.unique(self._codes(g), return_inverse=True) for g in (a, b))
                measure = 0.0
                for w in (n * (1 - q), n * q):
                    joint = np.bincount(i * len(v) + j, w, len(u) * len(v)).reshape(len(u), len(v))
                    total = joint.sum()
                    expected = np.outer(joint.sum(1), joint.sum(0)) / max(total, 1e-9)
                    chance = ((joint - expected) ** 2 / np.maximum(expected, 1e-9)).sum()
                    freedom = max(1, (len(u) - 1) * (len(v) - 1))
                    if chance > 10 * freedom and total > 20:
                        measure = max(measure, np.sqrt(chance / total / max(1, min(len(u), len(v)) - 1)))
                if measure > best:
                    best, chosen = measure, (a, b)
        return chosen

    def accuracies(self) -> dict[int, tuple[float, float]]:
        """Per voter: how often it says 1 in class 1 and in class 0."""
        found = {}
        for j in range(self.patterns.shape[1]):
            said = self.patterns[:, j] == 1
            found[j] = tuple(float((said * w * self.counts).sum() / max(1e-9, (w * self.counts).sum())) for w in (self.posterior, 1 - self.posterior))
        return found


# ---- Classifier ---------------------------------------------------------------------------------
def fit(
    groups: np.ndarray, terms: list[list[int]], target: np.ndarray, weight: np.ndarray, n_terms: int, ridge: float = 0.2, steps: int = 50
) -> dict:
    """Weighted logistic regression on soft labels by Newton steps; the group features are scaled, a term is there or not."""
    x = np.zeros((len(groups), 1 + N_GROUP_FEATURES + n_terms))
    x[:, 0] = 1
    mean, scale = (groups.mean(0), groups.std(0)) if len(groups) else (np.zeros(N_GROUP_FEATURES), np.ones(N_GROUP_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    if len(groups):
        x[:, 1 : 1 + N_GROUP_FEATURES] = (groups - mean) / scale
    for i, found in enumerate(terms):
        x[i, [1 + N_GROUP_FEATURES + t for t in found if t < n_terms]] = 1
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (weight * (target - p)) - penalty * weights)
        weights += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return {"mean": mean, "scale": scale, "weights": weights, "n_terms": n_terms}


def score(model: dict, groups: np.ndarray, terms) -> np.ndarray:
    w, base = model["weights"], 1 + N_GROUP_FEATURES
    odds = w[0] + ((groups - model["mean"]) / model["scale"]) @ w[1:base]
    odds += [sum(w[base + t] for t in found if t < model["n_terms"]) for found in terms]
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


# ---- Operator -----------------------------------------------------------------------------------
TERMS_IN_CLASSIFIER = 300


class Toxicity:
    """The fitted models for ``docs``: ``scores`` has one row per document (doc_id, held_out, n_words, votes, posterior, score).

    ``held_out`` is a condition on the rows (a column); their labels and texts are used for no model."""

    def __init__(
        self, docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_training: int = MAX_TRAINING, max_terms: int = MAX_TERMS,
    ) -> None:
        spark = docs.sparkSession
        small_batches(spark)
        known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
        known = known.groupBy("id").agg(F.avg("label").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("body"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
        taught = rows.where("NOT held_out").select("id").distinct().join(known, "id")
        chosen = stored(bounded_sample(taught, max_training, "id", "label"), "sample")
        sample = stored(rows.where("NOT held_out").join(chosen, "id").select("body", "label"), "sample-texts")
        self.terms = mined_terms(sample, most=max_terms)
        found = rows.withColumn("f", self._features()).select("id", "held_out", "f.*")
        self.rows = stored(found.join(known.where("id IS NOT NULL"), "id", "left"), "votes")
        self.label_model = self._label_model()
        self.classifier = self._classifier(max_training)

    def _features(self) -> Column:
        terms = self.terms

        @F.pandas_udf("n_words long, votes int, groups array<float>, terms array<int>")
        def features(texts: pd.Series) -> pd.DataFrame:
            matcher = _matcher(tuple(terms))
            return pd.DataFrame([matcher(t) for t in texts], columns=NAMES)

        return features("body")

    @staticmethod
    def _annotation() -> Column:
        return F.when(F.col("label").isNull(), 0).when(F.col("label") >= 0.5, 1).otherwise(2)

    def _label_model(self) -> LabelModel:
        training = self.rows.where("NOT held_out").groupBy("votes", self._annotation().alias("label")).count().collect()
        n = len(VOTERS)
        patterns = np.array([[r.votes >> i & 1 for i in range(n)] + [r.label] for r in training], dtype=np.int64).reshape(-1, n + 1)
        self._patterns = [(r.votes, r.label) for r in training]
        return LabelModel(patterns, np.array([r["count"] for r in training]), n, VOTERS.index("none"))

    def _posteriors(self, rows: DataFrame) -> DataFrame:
        """Add the posterior label of training rows; their patterns are the few thousand of the label model."""
        spark = rows.sparkSession
        found = [(v, a, float(p)) for (v, a), p in zip(self._patterns, self.label_model.posterior, strict=True)]
        table = spark.createDataFrame(found, "votes int, annotation int, posterior double")
        return rows.withColumn("annotation", self._annotation()).join(F.broadcast(table), ["votes", "annotation"], "left").drop("annotation")

    def _classifier(self, most: int) -> dict:
        """Fitted to a sample, half of it from the rows with a vote, as those without one are many and alike; rows count as many as they
        stand for."""
        voted = F.col("votes").bitwiseAND((1 << VOTERS.index("none")) - 1) != 0
        training = self._posteriors(self.rows.where("NOT held_out")).select("id", "votes", "n_words", "groups", "terms", "posterior")
        sample, weight = [], []
        for part in (training.where(voted), training.where(~voted)):
            drawn = bounded_sample(part, most // 2, "id", "votes", "n_words").collect()
            sample += drawn
            weight += [part.count() / max(1, len(drawn))] * len(drawn)
        groups = np.array([r.groups for r in sample], dtype=float).reshape(-1, N_GROUP_FEATURES)
        weights = np.array(weight) / max(1e-9, np.mean(weight)) if weight else np.zeros(0)
        target = np.array([r.posterior for r in sample])
        return fit(groups, [r.terms for r in sample], target, weights, min(TERMS_IN_CLASSIFIER, len(self.terms)))

    @property
    def scores(self) -> DataFrame:
        model = self.classifier

        @F.pandas_udf("double")
        def scored(groups: pd.Series, terms: pd.Series) -> pd.Series:
            return pd.Series(score(model, np.array(groups.tolist(), dtype=float).reshape(-1, N_GROUP_FEATURES), terms))

        rows = self._posteriors(self.rows).withColumn("score", scored("groups", "terms"))
        return rows.select(F.col("id").alias("doc_id"), "held_out", "n_words", "votes", "posterior", "score")


_kept: dict[tuple[str, ...], Matcher] = {}


def _matcher(terms: tuple[str, ...]) -> Matcher:
    """The searcher of a worker, built once."""
    if terms not in _kept:
        _kept.clear()
        _kept[terms] = Matcher(list(terms))
    return _kept[terms]


def op11_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = Toxicity(docs, labels, held_out).scores
    return found.withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
