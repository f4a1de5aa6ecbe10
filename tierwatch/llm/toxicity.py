"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are classified by a lexical transducer: a weighted trie (learned from
labelled rows, with backing off from longer to shorter stems) gives insults,
small fixed lists give threats, targets, negations and reported speech.  The
class string of a clause runs through the composition of five transducers:

    negation   remembers a negator for the next ``REACH`` words
    report     remembers a reporting verb or an opening quote in the clause
    target     remembers that somebody is addressed
    threat     emits at a threatening word
    insult     emits at an insulting word

so a clause yields matches labelled plain, targeted, negated or reported, each
with the insult's weight, and not mere words.  A text's matches are summed by
label and a logistic model (fitted on other labelled rows than the trie)
turns the sums into a score.

Learning uses at most ``MAX_ROWS`` labelled rows, chosen by the hash of the
id, and every stem of at least ``SUPPORT`` toxic documents; only stems that
decide nothing (neutral below a neutral one) are left out.  A row's fold is
crc32(doc_id as text) mod 5 and fold 0 is never read.  Scoring is one scan
without shuffle, over whole texts.

Defined results: null or empty text has no matches and the model's base score;
without labelled rows of both kinds the fixed insults and fixed weights decide;
repeated rows are scored each; repeated labels of an id count as toxic if any
says so; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_width, small_batches, tidy

MAX_ROWS = 40_000
STEMS = range(3, 11)          # stem lengths; a whole word ends in END
END = "$"
REACH = 3
FLOOR = 1.5                   # smallest weight of an insult
SUPPORT = 3                   # toxic documents of a learned stem

# FIXED VALUES: small word lists of the grammar's closed classes
INSULTS = ("idiot moron loser scum trash stupid pathetic worthless disgusting clown "
           "dummkopf trottel abschaum imbecile connard ordure imbecil basura escoria").split()
THREATS = ("kill hurt destroy burn beat shoot stab murder töten vernichten verletzen "
           "tuer frapper brûler matar golpear quemar").split()
TARGETS = ("you your yours they them their he him she her these those du dich dir ihr euch sie "
           "tu te toi vous ils elles él ella ellos usted ustedes vosotros").split()
NEGATORS = "not never no isn't aren't don't nicht nie kein keine ne jamais aucun nunca jamás ningún".split()
REPORTS = ("said says told wrote claimed called quoted sagte sagt schrieb nannte dit écrit appelé "
           "dijo dice escribió llamó").split()
_CLAUSE_ENDS = ".!?;:"
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”’‘…–—¿¡"
OTHER, INSULT, THREAT, TARGET, NEGATOR, REPORT = range(6)
LABELS = ("plain", "targeted", "negated", "reported", "threat")
FEATURES = len(LABELS) + 3


# ------------------------------------------------------------- transducers

@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer over word classes: ``step`` maps (state,
    class) to a state, staying if absent, or to ``rest`` of the state."""
    step: dict = field(hash=False)
    rest: dict = field(hash=False)

    def next(self, state: int, kind: int) -> int:
        return self.step.get((state, kind), self.rest.get(state, state))


NEGATION = Transducer({(s, NEGATOR): REACH for s in range(REACH + 1)}, {s: s - 1 for s in range(1, REACH + 1)})
REPORTED = Transducer({(0, REPORT): 1}, {})
TARGETED = Transducer({(0, TARGET): 1}, {})
GRAMMAR = (NEGATION, REPORTED, TARGETED)


def matches(kinds: Iterable[int], weights: Iterable[float]) -> list[tuple[int, float]]:
    """(label, weight) of a clause: the composed machine's outputs.  A target
    may follow the insult, so plain matches are relabelled at the end."""
    state, out = (0,) * len(GRAMMAR), []
    for kind, weight in zip(kinds, weights):
        if kind == INSULT:
            out.append((2 if state[0] else 3 if state[1] else 0, weight))
        elif kind == THREAT:
            out.append((4, 1.0 if not state[0] else 0.0))
        state = tuple(t.next(s, kind) for t, s in zip(GRAMMAR, state))
    if state[2]:
        return [(1 if label == 0 else label, w) for label, w in out]
    return [(label, w) for label, w in out if label != 4]        # a threat needs a target


# -------------------------------------------------------- the word classes

@dataclass
class Model:
    nodes: dict            # stem -> weight, with its backing off already applied
    weights: np.ndarray    # of the features, the last is the constant
    heads: set = field(default_factory=set)

    def __post_init__(self):
        self.heads = {n[:STEMS[0]] for n in self.nodes}

    def weight(self, word: str) -> float:
        """Weight of the longest known stem of the word."""
        if word[:STEMS[0]] not in self.heads:
            return 0.0
        got = self.nodes.get(word + END)
        if got is not None:
            return got
        for k in range(min(len(word), STEMS[-1]), STEMS[0] - 1, -1):
            got = self.nodes.get(word[:k])
            if got is not None:
                return got
        return 0.0


_FIXED = {**dict.fromkeys(THREATS, THREAT), **dict.fromkeys(TARGETS, TARGET),
          **dict.fromkeys(NEGATORS, NEGATOR), **dict.fromkeys(REPORTS, REPORT)}


def _classes(tokens: list[str], model: Model):
    kind = np.zeros(len(tokens), np.int8)
    weight = np.zeros(len(tokens), np.float32)
    ends = np.zeros(len(tokens), bool)
    for i, t in enumerate(tokens):
        if t and t[-1] in _CLAUSE_ENDS:
            ends[i] = True
        w = t.strip(_EDGES)
        k = _FIXED.get(w)
        if k is not None:
            kind[i] = k
            continue
        x = model.weight(w)
        if x >= FLOOR:
            kind[i], weight[i] = INSULT, x
    return kind, weight, ends


def features(texts: pa.Array, model: Model) -> np.ndarray:
    """One row per text: summed weights by label, matches, strongest match and
    weight per 100 words."""
    lines = pc.replace_substring(pc.utf8_lower(texts), "\n", " . ")
    words = pc.ascii_split_whitespace(lines)
    off = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    kind, weight, ends = _classes(coded.dictionary.to_pylist(), model)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    off = off - off[0]
    out = np.zeros((len(texts), FEATURES))
    clause = np.cumsum(ends[codes])
    begin = np.concatenate(([0], np.flatnonzero(ends[codes]) + 1))
    hot = np.flatnonzero((kind[codes] == INSULT) | (kind[codes] == THREAT))
    clause_of = clause - ends[codes]                      # a closing word belongs to its clause
    doc_of = np.searchsorted(off, hot, "right") - 1
    seen = set()
    for at, doc in zip(hot, doc_of):
        spot = (doc, clause_of[at])
        if spot in seen:
            continue
        seen.add(spot)
        a = max(begin[clause_of[at]], off[doc])
        b = begin[clause_of[at] + 1] if clause_of[at] + 1 < len(begin) else len(codes)
        c = codes[a:min(b, off[doc + 1])]
        for label, w in matches(kind[c], weight[c]):
            out[doc, label] += w
            out[doc, 5] += 1
            out[doc, 6] = max(out[doc, 6], w if label != 2 else 0.0)
    total = out[:, :5].sum(axis=1)
    out[:, 7] = np.log1p(100 * total / np.maximum(np.diff(off), 1))
    out[:, :6] = np.log1p(out[:, :6])
    return out


def scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.clip(x @ w[:-1] + w[-1], -30, 30)
    return 1 / (1 + np.exp(-z))


# ----------------------------------------------------------------- learning

def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, y, fold) of at most about ``max_rows`` training rows;
    their ids are small enough to broadcast by that bound."""
    known = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("y"))
             .withColumn("fold", fold()).where("fold <> 0"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")


def _stem_counts(rows: DataFrame) -> DataFrame:
    """(stem, hits, others): documents' distinct words, summed by stem."""
    edges = F.lit("^[\\p{P}\\p{S}]+|[\\p{P}\\p{S}]+$")
    words = rows.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), "\\s+"))).alias("w"))
    words = (words.groupBy("w").agg(F.sum("y").alias("hits"), F.sum(1 - F.col("y")).alias("others"))
             .withColumn("w", F.regexp_replace("w", edges, F.lit(""))).where(F.length("w") >= STEMS[0]))
    ends = [F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in STEMS]
    return (words.select(F.explode(F.array_compact(F.array(*ends, F.concat("w", F.lit(END))))).alias("stem"), "hits", "others")
            .groupBy("stem").agg(F.sum("hits").alias("hits"), F.sum("others").alias("others")))


def _walk(counts: Iterable[tuple[str, int, int]], scale: float, root: float, backing: float):
    """(stem, log odds, log odds of its parent or None) of stems in text
    order; a rate is drawn to that of the longest counted stem within it."""
    path: list[tuple[str, float, float]] = []             # the stems that the last one starts with
    for stem, hits, others in counts:
        while path and not stem.startswith(path[-1][0]):
            path.pop()
        _, rate, above = path[-1] if path else ("", root, None)
        rate = (hits + backing * rate) / (hits + others * scale + backing)
        p = min(max(rate, 1e-4), 1 - 1e-4)
        weight = math.log(p / (1 - p))
        yield stem, weight, above
        path.append((stem, rate, weight))


def learn_nodes(counts: list[tuple[str, int, int]], toxic: int, clean: int,
                root: float = 0.2, backing: float = 1.0) -> dict[str, float]:
    """Log odds of every counted stem; its rate is drawn to its parent's."""
    return {stem: w for stem, w, _ in _walk(sorted(counts), (toxic + 1) / (clean + 1), root, backing)}


def deciding_nodes(counts: DataFrame, toxic: int, clean: int,
                   root: float = 0.2, backing: float = 1.0) -> DataFrame:
    """(stem, weight) of the counted stems that decide a word's class: insults,
    neutral stems below an insult and those of fixed insults.  A word whose
    longest stem is left out finds a neutral one or none, which is the same.

    A stem's parents share its first letters, so a task has all of them and
    walks its stems in text order, holding one path."""
    scale = (toxic + 1) / (clean + 1)
    fixed = {w + END for w in INSULTS}

    def run(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        keep = ((s, w) for s, w, above in _walk(rows, scale, root, backing)
                if w >= FLOOR or s in fixed or (above is not None and above >= FLOOR))
        while part := list(islice(keep, 10_000)):
            yield pa.record_batch([pa.array([s for s, _ in part], pa.string()),
                                   pa.array([w for _, w in part], pa.float64())], ["stem", "weight"])
    return (counts.select("stem", "hits", "others")
            .repartition(shuffle_width(counts.sparkSession), F.substring("stem", 1, STEMS[0]))
            .sortWithinPartitions("stem").mapInArrow(tidy(run), "stem string, weight double"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Newton steps for a ridge logistic model; the constant comes last."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


_FIXED_WEIGHTS = np.array([1.0, 1.2, 0.1, 0.4, 1.0, 0.5, 0.5, 0.5, -3.0])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Trie from folds 1 to 3, logistic weights from fold 4."""
    rows = cut(_labelled(docs, labels, max_rows), "labelled")
    sizes = {int(r[0]): r[1] for r in rows.where("fold <> 4").groupBy("y").count().collect()}
    nodes = {w + END: 6.0 for w in INSULTS}
    if sizes.get(1) and sizes.get(0):
        counts = _stem_counts(rows.where("fold <> 4")).where(F.col("hits") >= SUPPORT)
        nodes.update(deciding_nodes(counts, sizes[1], sizes[0]).collect())      # bounded by MAX_ROWS
    model = Model(nodes, _FIXED_WEIGHTS)

    def run(batches):
        for b in batches:
            x = features(b.column("text"), model)
            yield pa.record_batch([b.column("y").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])
    got = rows.where("fold = 4").select("text", "y").mapInArrow(tidy(run), "y int, x array<double>").collect()  # <= MAX_ROWS
    y = np.array([r[0] for r in got], float)
    if len(y) and 0 < y.sum() < len(y):
        order = np.lexsort(np.array([r[1] for r in got]).T)
        model.weights = logistic(np.array([r[1] for r in got])[order], y[order])
    return model


def score(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """(doc_id, the ``carry`` columns, score): one scan, no shuffle."""
    src = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("_scored"))
    small_batches(docs.sparkSession)
    names = ["doc_id", *carry]
    kinds = dict(src.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double"

    def run(batches):
        for b in batches:
            s = scores(features(b.column("_scored"), model), model.weights)
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(s)], [*names, "score"])
    return src.mapInArrow(tidy(run), schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
