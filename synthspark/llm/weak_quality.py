"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document. How often each of them is right is
estimated without labels: expectation-maximisation over the counts of vote patterns, of which there are at most
``3 ** labellers`` whatever the corpus. The posterior of a document's pattern is its soft label, and a linear scorer
over hashed words and word shapes learns these labels, so that it also judges documents on which labellers abstain.

Two tasks are learned side by side: quality, and abusive language. The scorers are fitted on a bounded sample
(``SAMPLE_ROWS``); votes are counted over all documents and every whole text is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthspark.session import stored

# Most documents that the scorers are fitted on.
SAMPLE_ROWS = 4_000
BUCKETS = 1 << 15
_STEPS = 150
_RIDGE = 1e-3
_ROUNDS = 200
_REMEMBERED = 100_000
_SHAPES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")

_EDGES = ".,;:!?\"'()"

# Common English insults.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile fool loser losers trash garbage scum scumbag vermin "
    "worthless pathetic disgusting clown clowns jerk bastard asshole bitch crap cretin dimwit halfwit lowlife pig swine filth "
    "freak creep coward retard slut whore wanker twat prick douchebag".split()
)
_STRONG = frozenset("scum scumbag vermin asshole bastard bitch slut whore retard filth worthless disgusting trash idiot moron".split())


class _Traits(dict):
    """What is known of a word: two buckets, then marked, wordless, capitals, characters, insult, strong insult.

    Words not met for a while are forgotten.
    """

    def __missing__(self, word: str) -> tuple[int, ...]:
        core = word.strip(_EDGES)
        lower = core.lower()
        plain = core.isalpha()
        shape = word.replace(core, _kind(core)) if plain else _SHAPES.sub(_shape, word)
        half = BUCKETS // 2
        marks = (0 if plain else sum(not c.isalnum() for c in core)) + max(0, len(word) - len(core) - 1)
        traits = (
            zlib.crc32(lower.encode("utf-8", "surrogatepass")) % half,
            half + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % half,
            int(marks > 0),
            int(not plain and not any(map(str.isalpha, core))),
            len(core) if len(core) > 1 and core.isupper() else 0,
            len(core),
            int(lower in INSULTS),
            int(lower in _STRONG),
        )
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = traits
        return traits


def _shape(found: re.Match) -> str:
    run = found.group()
    return _kind(run) if run[0].isalpha() else "9" if run[0].isdigit() else run[:2]


def _kind(letters: str) -> str:
    return "a" if letters[0].islower() else "A" if len(letters) > 1 and letters.isupper() else "Aa"


_traits = _Traits()


class Bag:
    """Distinct words of a text: how often each occurs and its traits."""

    def __init__(self, text: str) -> None:
        counted = Counter(text.split())
        self.words = counted.total()
        self.times = np.fromiter(counted.values(), np.int64, len(counted))
        flat = np.fromiter(chain.from_iterable(map(_traits.__getitem__, counted)), np.int64, 8 * len(counted))
        self.traits = flat.reshape(-1, 8)


@dataclass
class Facts:
    """What the labellers look at; one pass over the words of a text."""

    words: int
    distinct: int
    top: int
    marked: int
    wordless: int
    upper: int
    letters: int
    lines: int
    repeated_lines: int
    insults: int
    distinct_insults: int
    strong: int

    @classmethod
    def of(cls, text: str, bag: Bag) -> Facts:
        marked, wordless, upper, letters, insults, strong = (bag.times @ bag.traits[:, 2:]).tolist()
        lines = [x for x in text.split("\n") if x.strip()]
        kinds = int(bag.traits[:, 6].sum())
        return cls(bag.words, len(bag.times), int(bag.times.max(initial=0)), marked, wordless, upper, letters, len(lines), len(lines) - len(set(lines)), insults, kinds, strong)


# A labeller gives 1 (the class is there), 0 (it is not) or -1 (abstains).
Labeller = Callable[[Facts], int]


def _band(share: float, low: float, high: float) -> int:
    """Good up to ``low``, bad from ``high`` on, and no opinion between."""
    return 1 if share <= low else 0 if share >= high else -1


QUALITY: dict[str, Labeller] = {
    "few_marks": lambda f: _band(f.marked / max(1, f.words), 0.06, 0.25),
    "few_wordless": lambda f: _band(f.wordless / max(1, f.words), 0.05, 0.2),
    "few_capitals": lambda f: _band(f.upper / max(1, f.letters), 0.08, 0.4),
    "varied": lambda f: _band(f.top / max(1, f.words), 0.12, 0.3) if f.words >= 20 else -1,
    "distinct": lambda f: _band(1 - f.distinct / min(f.words, 400), 0.6, 0.85) if f.words >= 20 else -1,
    "word_length": lambda f: _band(abs(math.log(max(1e-9, f.letters / max(1, f.words)) / 5)), 0.6, 1.1),
    "new_lines": lambda f: _band(f.repeated_lines / f.lines, 0.1, 0.4) if f.lines >= 4 else -1,
    "some_length": lambda f: 0 if f.words < 3 else 1 if f.words >= 40 else -1,
}
ABUSE: dict[str, Labeller] = {
    "insult": lambda f: int(f.insults > 0),
    "insults": lambda f: 1 if f.insults > 1 else 0 if f.insults == 0 else -1,
    "strong": lambda f: 1 if f.strong else 0 if f.insults == 0 else -1,
    "kinds": lambda f: 1 if f.distinct_insults > 1 else 0 if f.distinct_insults == 0 else -1,
}


@dataclass(frozen=True)
class LabelModel:
    """Prior of the class, and per labeller and class the chances of the votes -1, 0, 1."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of the class for each row of votes."""
        logs = np.log(np.array([1 - self.prior, self.prior]))
        chosen = np.log(self.votes)[np.arange(self.votes.shape[0])[None, :], :, patterns + 1]
        both = logs + chosen.sum(axis=1)
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = _ROUNDS) -> LabelModel:
    """Expectation-maximisation from the majority of votes; a half vote of smoothing keeps all chances positive.

    A labeller that a class makes neither more nor less likely to vote for it carries no weight. Without any vote the
    prior stays one half.
    """
    if not len(patterns):
        return LabelModel(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    yes, no = (patterns == 1).sum(axis=1), (patterns == 0).sum(axis=1)
    chance = (yes + 0.5) / (yes + no + 1.0)
    width = patterns.shape[1]
    model = LabelModel(0.5, np.full((width, 2, 3), 1 / 3))
    for _ in range(rounds):
        weights = np.stack([(1 - chance) * counts, chance * counts])
        votes = np.full((width, 2, 3), 0.5)
        for value in range(3):
            votes[:, :, value] += ((patterns + 1 == value).T.astype(float) @ weights.T)
        # A labeller is taken to be no worse than a coin: what it says of a class is likelier there.
        votes /= votes.sum(axis=2, keepdims=True)
        prior = float((weights[1].sum() + 0.5) / (counts.sum() + 1))
        model = LabelModel(min(max(prior, 1e-4), 1 - 1e-4), votes)
        new = model.posterior(patterns)
        if np.abs(new - chance).max() < 1e-7:
            break
        chance = new
    return model


def features(bag: Bag) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how many words fall into them; every word has one for itself and one for its shape."""
    if not bag.words:
        return np.zeros(0, "<u2"), np.zeros(0, np.uint8)
    places, inverse = np.unique(bag.traits[:, :2], return_inverse=True)
    counts = np.bincount(inverse.ravel(), weights=np.repeat(bag.times, 2))
    return places.astype("<u2"), counts.astype(np.uint8 if counts.max() < 256 else "<u4")


def _flat(places: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all rows, their values (roots of shares, words and shapes each a unit vector) and the row of each."""
    sizes = np.array([len(p) // 2 for p in places], np.int64)
    owner = np.repeat(np.arange(len(places)), sizes)
    flat = [np.frombuffer(c, np.uint8 if len(c) == n else "<u4").astype(np.float64) for c, n in zip(counts, sizes.tolist())]
    held = np.concatenate([np.zeros(0), *flat])
    words = np.bincount(owner, weights=held, minlength=len(places)) / 2
    return np.frombuffer(b"".join(places), "<u2").astype(np.int64), np.sqrt(held / words[owner]), owner


def _fit_scorer(places: np.ndarray, values: np.ndarray, owner: np.ndarray, soft: np.ndarray) -> np.ndarray:
    """Logistic scorer of soft labels over sparse rows; both classes weigh the same; the last weight is the constant."""
    rows = len(soft)
    weights = np.zeros(BUCKETS + 1)
    ahead = weights.copy()
    balance = soft / max(soft.sum(), 1e-9) / 2 + (1 - soft) / max((1 - soft).sum(), 1e-9) / 2
    for k in range(_STEPS):
        out = np.bincount(owner, weights=values * ahead[places], minlength=rows) + ahead[-1]
        pull = balance * (1 / (1 + np.exp(-np.clip(out, -50, 50))) - soft)
        grad = np.concatenate([np.bincount(places, weights=values * pull[owner], minlength=BUCKETS), [pull.sum()]]) + _RIDGE * ahead
        # Rows are two unit vectors beside a constant one, so the curvature is at most three quarters.
        new = ahead - grad / (0.75 + _RIDGE)
        ahead = new + (new - weights) * (k / (k + 3))
        weights = new
    return weights


@dataclass(frozen=True)
class QualityModel:
    """Label models and scorers by task name."""

    tasks: tuple[str, ...]
    labels: dict[str, LabelModel]
    scorers: dict[str, np.ndarray]


TASKS = {"quality": QUALITY, "abuse": ABUSE}


_FEATURES = "draw bigint, " + ", ".join(f"{t} array<int>" for t in TASKS) + ", places binary, counts binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(2):
            text = value.as_py() or ""
            bag = Bag(text)
            facts = Facts.of(text, bag)
            rows.append((*[[rule(facts) for rule in rules.values()] for rules in TASKS.values()], *(x.tobytes() for x in features(bag))))
        columns = list(zip(*rows)) if rows else [()] * (len(TASKS) + 2)
        kinds = [pa.list_(pa.int32())] * len(TASKS) + [pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["id", "draw", *TASKS, "places", "counts"])


def featurize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, draw, votes per task, places, counts)`` per row: all that fitting and scoring need, from one reading of the texts.

    ``draw`` is the hash of id and text that sampling goes by. Null and empty texts vote like texts without words.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit("quality"), F.col(id_col), text).alias("draw"), text.alias("text"))
    return rows.mapInArrow(_read, f"id {rows.schema['id'].dataType.simpleString()}, {_FEATURES}")


def fit(table: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Label models from the votes of all rows of a stored ``featurize`` table, scorers from the ``sample_rows`` rows drawn first.

    Which rows are drawn does not hang on the table's partitions. An empty table gives a model that scores everything one half.
    """
    counted = table.groupBy(*TASKS).agg(F.count("*").alias("n")).collect()
    labels = {}
    for task, rules in TASKS.items():
        patterns = np.array([r[task] for r in counted], np.int64).reshape(-1, len(rules))
        labels[task] = estimate(patterns, np.array([r["n"] for r in counted], float))
    # The last draw is found first, on that column alone.
    last = table.select("draw").orderBy("draw").limit(sample_rows).agg(F.max("draw")).first()[0]
    taken = table.where(F.col("draw") <= F.lit(last)).orderBy("draw").limit(sample_rows).select(*TASKS, "places", "counts").toArrow()
    places, values, owner = _flat(taken.column("places").to_pylist(), taken.column("counts").to_pylist())
    scorers = {}
    for task, rules in TASKS.items():
        patterns = np.array(taken.column(task).to_pylist(), np.int64).reshape(-1, len(rules))
        soft = labels[task].posterior(patterns) if len(patterns) else np.zeros(0)
        scorers[task] = _fit_scorer(places, values, owner, soft) if len(soft) else np.zeros(BUCKETS + 1)
    return QualityModel(tuple(TASKS), labels, scorers)


def learn(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> QualityModel:
    """``fit`` on documents."""
    return fit(stored(featurize(docs, id_col, text_col), "quality"), sample_rows)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, quality_label, quality, abuse_label, abuse, kept)`` per row.

    ``…_label`` is the posterior of the votes, the other one the scorer's chance. A document is kept if the scorer finds
    it good, and neither scorer nor votes find it abusive. Null, empty and wordless texts are not kept. Null ids and
    repeated rows are scored like any others; texts are read whole.
    """
    return score_features(featurize(docs, id_col, text_col), model)


def score_features(table: DataFrame, model: QualityModel) -> DataFrame:
    """``score`` from a ``featurize`` table."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    fields = [f"{t}{s}" for t in TASKS for s in ("_label", "")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = batch.column("places").to_pylist()
            places, values, owner = _flat(found, batch.column("counts").to_pylist())
            made = {}
            for task, rules in TASKS.items():
                patterns = batch.column(task).flatten().to_numpy().reshape(-1, len(rules)).astype(np.int64)
                made[f"{task}_label"] = known.labels[task].posterior(patterns)
                out = np.bincount(owner, weights=values * known.scorers[task][places], minlength=len(found)) + known.scorers[task][-1]
                made[task] = 1 / (1 + np.exp(-np.clip(out, -50, 50)))
            quality, abuse, abuse_label = made["quality"], made["abuse"], made["abuse_label"]
            worded = np.array([len(p) > 0 for p in found], bool)
            kept = worded & (quality >= 0.5) & ~((abuse >= 0.5) & (abuse_label >= 0.01)) & (abuse_label < 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(made[f]) for f in fields], pa.array(kept)], ["id", *fields, "kept"])

    kind = table.schema["id"].dataType.simpleString()
    return table.drop("draw").mapInArrow(run, f"id {kind}, " + ", ".join(f"{f} double" for f in fields) + ", kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """Quality and abuse scores of all documents."""
    table = stored(featurize(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality")
    return score_features(table, fit(table)).withColumnRenamed("id", "doc_id")
