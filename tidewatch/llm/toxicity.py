"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to symbols: insult, threat, target, negation, report and
quotation marks.  Small transducers each read one context (what is negated, what
is reported, who is addressed, whom a threat meets) and relabel insults and
threats; composed, they run once over a clause and emit its matched patterns.  A
text is scored by the weighted patterns of its clauses, so a negated or reported
insult counts by its own weight, learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import durable

from .common import DIGESTS

#: Labelled rows that the lexicon and weights are fitted on.
SAMPLE_ROWS = 12_000
#: A term is learned from at least so many toxic texts, this log-odds ratio and this likelihood ratio (G squared).
LEAST_TEXTS, LEAST_ODDS, LEAST_EVIDENCE = 5, 2.5, 24.0
PREFIXES = (4, 5, 6, 7)
SEED_WEIGHT = 3.0

INSULTS = (
    "idiot moron imbecile stupid fool dumb trash garbage scum vermin loser clown pathetic worthless disgusting filthy coward jerk"
    " idiota estúpido estúpida imbécil basura inútil asqueroso payaso escoria"
    " idiote stupide crétin ordure minable nul dégoûtant abruti racaille"
    " dumm dummkopf trottel abschaum müll erbärmlich widerlich versager vollidiot"
).split()
THREATS = "kill hurt destroy beat shoot stab burn hang matar golpear destruir tuer frapper détruire töten schlagen vernichten".split()
TARGETS = (
    "you your u he she they them his her their people guy guys man woman everyone tú usted ustedes ellos ellas él ella gente"
    " tu vous ils elles il elle eux gens du ihr sie er euch leute"
).split()
NEGATIONS = "not no never nobody isn't aren't don't won't nicht kein keine nie nunca ningún jamás pas jamais aucun".split()
REPORTS = "said says say called calls wrote writes reported quoted quote claims dijo llamó escribió dit appelle écrit sagte nannte schrieb".split()

PARTS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;:\n]|[\"“”„«»]")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
ENDS = frozenset(".!?;:\n")
PATTERNS = ("insult", "targeted", "negated", "reported", "threat")
#: Bias, and weights of the patterns, to which the fit is drawn.
PRIOR = np.array([-3.0, 0.8, 1.0, 0.3, 0.3, 0.5])

Steps = dict[tuple[object, str], tuple[object, str]]


def _marks(symbol: str, mark: str) -> str:
    return symbol if symbol[0] not in "IT" else symbol + mark


def _within(trigger: str, reach: int, mark: str, symbols: list[str]) -> Steps:
    """Marks insults and threats that come up to `reach` symbols after a trigger."""
    steps: Steps = {}
    for left in range(reach + 1):
        for symbol in symbols:
            then = reach if symbol == trigger else max(0, left - 1)
            steps[left, symbol] = (then, _marks(symbol, mark) if left else symbol)
    return steps


def _reports(symbols: list[str]) -> Steps:
    """Marks what follows a verb of speech in the clause, or stands in quotation marks."""
    steps: Steps = {}
    for said in (0, 1):
        for quoted in (0, 1):
            for symbol in symbols:
                then = (1 if symbol == "R" else said, 1 - quoted if symbol == "Q" else quoted)
                steps[(said, quoted), symbol] = (then, _marks(symbol, "r") if said or quoted else symbol)
    return steps


def _emits(symbols: list[str], reach: int = 3) -> Steps:
    """Turns marked insults into patterns, and threats into one once a target follows within `reach`."""
    steps: Steps = {}
    for left in range(reach + 1):
        for symbol in symbols:
            then, out = max(0, left - 1), ""
            if symbol[0] == "I":
                out = "reported" if "r" in symbol else "negated" if "n" in symbol else "targeted" if "t" in symbol else "insult"
            elif symbol[0] == "T" and not set("rn") & set(symbol):
                then = reach
            elif symbol == "Y" and left:
                then, out = 0, "threat"
            steps[left, symbol] = (then, out)
    return steps


def compose(first: Steps, second: Steps) -> Steps:
    """The transducer that feeds the output of one into another."""
    return {((a, b), symbol): ((a2, second[b, out][0]), second[b, out][1])
            for (a, symbol), (a2, out) in first.items() for b in {state for state, _ in second}}


def _numbered(steps: Steps, start: object) -> list[dict[str, tuple[int, str]]]:
    """The states reachable from the start, as a table."""
    number, table, todo = {start: 0}, [], [start]
    while todo:
        state = todo.pop(0)
        row = {}
        for symbol in "OITYNRQ":
            then, out = steps[state, symbol]
            if then not in number:
                number[then] = len(number)
                todo.append(then)
            row[symbol] = (number[then], out)
        table.append(row)
    return table


def grammar() -> list[dict[str, tuple[int, str]]]:
    """Reported speech, negation, target and pattern transducers, composed in this order."""
    plain = list("OITYNRQ")
    after_reports = plain + ["Ir", "Tr"]
    after_negation = after_reports + ["In", "Tn", "Irn", "Trn"]
    after_targets = after_negation + [s + "t" for s in after_negation if s[0] in "IT"]
    steps = compose(compose(compose(_reports(plain), _within("N", 3, "n", after_reports)), _within("Y", 4, "t", after_negation)), _emits(after_targets))
    return _numbered(steps, ((((0, 0), 0), 0), 0))


@dataclass(frozen=True)
class Model:
    symbols: dict[str, str]  # word -> symbol, other than insults
    insults: dict[str, float]  # word, or prefix with a final *, -> weight
    table: list[dict[str, tuple[int, str]]]
    weights: np.ndarray

    def insult(self, word: str) -> float:
        found = self.insults.get(word)
        if found is None:
            found = max((self.insults.get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) >= k), default=0.0)
        return found

    def features(self, text: str | None) -> list[float]:
        """Summed weights of the matched patterns; clauses without an insult or threat are passed over."""
        sums = dict.fromkeys(PATTERNS, 0.0)
        text = (text or "").lower()
        words = set(WORD.findall(text))
        hit = {w: x for w in words if (x := self.insult(w))}
        threats = {w for w in words if self.symbols.get(w) == "T"}
        if hit or threats:
            state, last = 0, SEED_WEIGHT
            for part in PARTS.findall(text):
                if part in ENDS:
                    state = 0
                    continue
                weight = hit.get(part)
                symbol = "I" if weight else self.symbols.get(part) or ("Q" if part in "\"“”„«»" else "O")
                state, out = self.table[state][symbol]
                if out:
                    sums[out] += weight or last
        return [min(x, 50.0) for x in sums.values()]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "*" for k in PREFIXES for w in words if len(w) >= k}


def _term_counts(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """In how many texts each term occurs; with `wanted`, only those terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(_terms(text) if wanted is None else _terms(text) & wanted)
        if counts:
            yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})

    return rows.select("text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _g_squared(a, b, toxic, clean):
    """Likelihood ratio of a term in a of `toxic` and b of `clean` texts against one common rate."""
    rate = (a + b) / max(toxic + clean, 1)
    part = lambda k, n: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(n * rate, 1e-9)), 0.0)
    return 2 * (part(a, toxic) + part(b, clean) + part(toxic - a, toxic * (1 - rate) / np.maximum(rate, 1e-9)) + part(clean - b, clean * (1 - rate) / np.maximum(rate, 1e-9)))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from (doc_id, text, toxic); rows without a text or a label are no evidence.

    It is fitted on about `sample_rows` rows, chosen by a digest of the doc_id.
    Near copies, texts that share their smallest shingle hash, count once per
    label, so that words of a much copied text don't pass for insults.  Terms
    are words and prefixes of words; their counts are summed in Spark.
    """
    rows = labelled.where("text is not null and toxic is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    total = rows.count()
    if total > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(DIGESTS)) < DIGESTS * sample_rows // total)
    words = "split(lower(text), '[^\\\\p{L}]+')"
    sketch = f"transform(array({words}), w -> array_min(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))))[0]"
    rows = durable(rows.withColumn("sketch", F.expr(sketch)).dropDuplicates(["sketch", "toxic"]).select("text", "toxic"))
    totals = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    seeds = frozenset(INSULTS)
    a = _term_counts(rows.where("toxic = 1"), None).where((F.col("n") >= LEAST_TEXTS) | F.col("term").isin(*seeds))
    hits = dict(a.collect())
    wanted = frozenset(hits) | seeds
    misses = dict(_term_counts(rows.where("toxic = 0"), wanted).collect())
    insults = {}
    if wanted:
        names = sorted(wanted)
        x, y = (np.array([d.get(w, 0) for w in names], float) for d in (hits, misses))
        odds = np.log((x + 0.5) / (toxic + 1)) - np.log((y + 0.5) / (clean + 1))
        learned = (x >= LEAST_TEXTS) & (odds >= LEAST_ODDS) & (_g_squared(x, y, toxic, clean) >= LEAST_EVIDENCE)
        seeded = np.array([w in seeds for w in names]) & ((x + y == 0) | (odds > 0))
        for i in sorted(np.flatnonzero(learned), key=lambda i: (-odds[i] * x[i], names[i])):
            insults[names[i]] = float(odds[i])
        for i in np.flatnonzero(seeded):
            insults.setdefault(names[i], SEED_WEIGHT)
    symbols = {w: s for s, of in (("T", THREATS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in of}
    model = Model(symbols, insults, grammar(), PRIOR)
    seen = rows.select("toxic", features(F.col("text"), model).alias("x")).toPandas()
    if not len(seen):
        return model
    x, y = np.c_[np.ones(len(seen)), np.array(seen["x"].tolist())], seen["toxic"].to_numpy(float)
    weights = PRIOR.copy()
    for _ in range(50):  # Newton steps of a logistic regression drawn to the prior
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (y - p) - (weights - PRIOR)
        weights = weights + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(weights)), slope), -1, 1)
    return Model(symbols, insults, model.table, weights)


def features(text: Column, model: Model) -> Column:
    """Summed weights of the insult, targeted, negated, reported and threat patterns of a text."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.features(t) for t in texts], dtype=object)

    return run(text)


def score(text: Column, model: Model) -> Column:
    """How likely a text is toxic, 0 to 1.  NULL, empty and blank texts have no clause and get the score of a text without a match."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([model.features(t) for t in texts])))

    return run(text)
