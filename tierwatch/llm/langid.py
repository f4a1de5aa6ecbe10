"""Language identification by segmentation-marginalised unigrams.

Every language has its own probabilities of the pieces of one fixed public
vocabulary.  A word's probability is the sum over all its segmentations into
pieces (forward algorithm); a text's is the product over its words, and the
language with the largest posterior wins.

Learning (expectation maximisation over all segmentations, forward-backward)
uses at most ``MAX_DOCS`` documents a language, chosen by the hash of the id;
a document's fold is crc32(doc_id as text) mod 5 and fold 0 is never read.
Word counts and expected piece counts are summed by Spark; only the table of
piece probabilities (vocabulary times languages) reaches the driver.  Scoring
is one scan without shuffle: each batch scores its distinct words once.

Defined results: null text or a text without a letter is ``und`` with score 0;
without learned languages every text is ``und``; ties go to the language that
sorts first; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, small_batches
from .toxicity import fold

MAX_DOCS = 1500
ROUNDS = 3
MAX_PIECE = 12
MAX_LEARNED = 64             # letters; longer runs are scored but not learned from
START = "▁"                  # begins every word, as in the vocabulary
UNKNOWN = "und"
_RUNS = regex.compile(r"\p{L}+")
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SHIFT = 44
_FLOOR = -16.0               # log probability of a symbol that no piece covers


@dataclass
class Pieces:
    """The vocabulary as sorted hashes, and whether any begins with some bits."""
    hashes: np.ndarray
    size: int
    begun: np.ndarray = field(init=False)

    def __post_init__(self):
        self.begun = np.zeros(1 << (64 - _SHIFT), bool)
        self.begun[(self.hashes >> _U(_SHIFT)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.begun[(h >> _U(_SHIFT)).astype(np.int64)])      # few others get to the search
        at = np.minimum(np.searchsorted(self.hashes, h[some]), self.size - 1)
        good = self.hashes[at] == h[some]
        out[some[good]] = at[good]
        return out


def _hashes(codes: np.ndarray, length: int, before: np.ndarray | None) -> np.ndarray:
    """Hashes of all runs of ``length`` symbols, from those one shorter."""
    one = mix(codes.astype(_U) + _U(1))
    return one if before is None else before[:-1] * _BASE + one[length - 1:]


@lru_cache(maxsize=2)
def read_pieces(path: str) -> Pieces:
    """Lower-case letter pieces of a sentence-piece vocabulary file, each also
    with and without the start of a word; a fixed table, read on each worker."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        body = piece.lstrip(START)
        if body and body.isalpha() and len(piece) <= MAX_PIECE:
            found.add(piece)
            found.add(body)
    found.add(START)
    hashes = []
    for piece in found:
        codes = np.fromiter(map(ord, piece), np.int64, len(piece))
        h = None
        for k in range(1, len(codes) + 1):
            h = _hashes(codes, k, h)
        hashes.append(h[0])
    return Pieces(np.unique(np.array(hashes, _U)), len(set(hashes)))


def _lattice(words: list[str], pieces: Pieces):
    """Symbols of all words, their starts and lengths, and for each length the
    piece that starts at every position (-1: none, or beyond the word)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    room = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    ids, h = [], None
    for k in range(1, MAX_PIECE + 1):
        if len(codes) < k:
            break
        h = _hashes(codes, k, h)
        whole = np.flatnonzero(room[:len(h)] >= k)                 # runs within a word
        got = np.full(len(codes), -1, np.int64)
        got[whole] = pieces.find(h[whole])
        ids.append(got)
    return starts, sizes, ids


def _logs(p: np.ndarray, ids: np.ndarray, single: bool) -> np.ndarray:
    out = p[:, np.maximum(ids, 0)]
    return np.where(ids >= 0, out, _FLOOR if single else -np.inf)


def forward(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """(languages, words): log probability summed over all segmentations.
    Words are taken longest first, so that position t is one array step."""
    if not words:
        return np.zeros((len(p), 0))
    order = np.argsort(-np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    starts, sizes, ids = _lattice([words[i] for i in order], pieces)
    return _forward(starts, sizes, ids, p)[:, np.argsort(order)]


def _forward(starts, sizes, ids, p):
    n, top = len(starts), int(sizes[0])
    logs = np.vstack((p.T, np.full((1, len(p)), _FLOOR)))         # a row a piece; the last, -1, for no piece
    history = [np.zeros((n, len(p)))]
    total = np.zeros((n, len(p)))
    for t in range(1, top + 1):
        live = int(np.searchsorted(-sizes, -t, "right"))        # words of at least t symbols come first
        alpha = history[t - 1][:live] + logs[ids[0][starts[:live] + t - 1]]
        for k in range(2, min(t, len(ids)) + 1):
            piece = ids[k - 1][starts[:live] + t - k]
            some = np.flatnonzero(piece >= 0)                     # most longer runs are no piece
            if len(some):
                alpha[some] = np.logaddexp(alpha[some], history[t - k][some] + logs[piece[some]])
        history.append(alpha)
        if t > MAX_PIECE:
            history[t - MAX_PIECE - 1] = None
        ended = slice(int(np.searchsorted(-sizes, -t, "left")), live)
        total[ended] = alpha[ended]
    return total.T


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in one language's counted words (forward
    and backward over all segmentations); ``p`` has one row."""
    out = np.zeros(pieces.size)
    order = np.argsort(-np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    starts, sizes, ids = _lattice([words[i] for i in order], pieces)
    counts, n, top = counts[order], len(words), int(sizes[0])
    ahead = np.full((top + 1, n), -np.inf)
    ahead[0] = 0.0
    for t in range(1, top + 1):
        live = int(np.searchsorted(-sizes, -t, "right"))
        ahead[t, :live] = np.logaddexp.reduce([
            ahead[t - k, :live] + _logs(p, ids[k - 1][starts[:live] + t - k], k == 1)[0]
            for k in range(1, min(t, len(ids)) + 1)], axis=0)
    total = ahead[sizes, np.arange(n)]
    back = np.full((top + 1, n), -np.inf)
    back[sizes, np.arange(n)] = 0.0
    for t in range(top - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, "left"))         # words longer than t
        for k in range(1, min(top - t, len(ids)) + 1):
            fits = int(np.searchsorted(-sizes, -(t + k), "right"))
            if not fits:
                break
            piece = ids[k - 1][starts[:fits] + t]
            step = _logs(p, piece, k == 1)[0] + back[t + k, :fits]
            some = piece >= 0
            use = np.exp(ahead[t, :fits] + step - total[:fits]) * counts[:fits]
            np.add.at(out, piece[some], use[some])
            back[t, :fits] = np.logaddexp(back[t, :fits], step)
    return out


# ----------------------------------------------------------------- learning

@dataclass
class Model:
    languages: list[str]
    path: str
    logs: np.ndarray            # (languages, pieces)


_TOKEN_CACHE = 1 << 16       # words in one array step


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of the chosen learning documents."""
    known = docs.where("lang is not null and text is not null").withColumn("_fold", fold()).where("_fold <> 0")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}       # one row a language
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
                                                  < int(1_000_000 * min(1.0, MAX_DOCS / n)) + 1))
    runs = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0)))
    words = known.where(keep).select("lang", runs.alias("word")).where(F.length("word") <= MAX_LEARNED)
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, path: str, rounds: int = ROUNDS) -> Model:
    counts = cut(_word_counts(docs.select("doc_id", "text", "lang")), "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    pieces = read_pieces(path)
    logs = np.full((len(languages), pieces.size), -np.log(max(pieces.size, 1)))
    place = {lang: i for i, lang in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        def run(batches, logs=logs):
            known = read_pieces(path)
            for b in batches:
                for lang in pc.unique(b.column("lang")).to_pylist():
                    mine = b.filter(pc.equal(b.column("lang"), lang))
                    words = [START + w for w in mine.column("word").to_pylist()]
                    n = mine.column("n").to_numpy().astype(float)
                    i = place[lang]
                    use = np.zeros(known.size)
                    for at in range(0, len(words), _TOKEN_CACHE):
                        use += expected(words[at:at + _TOKEN_CACHE], n[at:at + _TOKEN_CACHE], known, logs[i:i + 1])
                    some = np.flatnonzero(use)
                    yield pa.record_batch([pa.array(np.full(len(some), i), pa.int32()), pa.array(some, pa.int32()),
                                           pa.array(use[some])], ["i", "piece", "uses"])
        sums = (counts.mapInArrow(run, "i int, piece int, uses double").groupBy("i", "piece")
                .agg(F.sum("uses").alias("uses")).collect())            # <= languages x vocabulary
        uses = np.full(logs.shape, 1e-2)
        for i, piece, n in sums:
            uses[i, piece] += n
        logs = np.log(uses / uses.sum(axis=1, keepdims=True))
    return Model(languages, path, logs)


def predict(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """(doc_id, the ``carry`` columns, lang_pred, score)."""
    src = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("_scored"))
    small_batches(docs.sparkSession)
    names = ["doc_id", *carry]
    kinds = dict(src.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double"
    languages = pa.array([*model.languages, UNKNOWN], pa.string())
    count = len(model.languages)

    def run(batches):
        pieces = read_pieces(model.path)
        for b in batches:
            words = pc.ascii_split_whitespace(pc.utf8_lower(b.column("_scored")))
            off = words.offsets.to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            value = np.zeros((count, len(coded.dictionary)))
            lettered = np.zeros(len(coded.dictionary), bool)
            for at in range(0, len(coded.dictionary), _TOKEN_CACHE):
                runs = [_RUNS.findall(t) for t in coded.dictionary.slice(at, _TOKEN_CACHE).to_pylist()]
                sizes = np.fromiter(map(len, runs), np.int64, len(runs))
                flat = [START + w for r in runs for w in r]
                some = np.flatnonzero(sizes)
                lettered[at + some] = True
                if count and len(flat):
                    once = pa.array(flat).dictionary_encode()     # signs around them make many words of a run
                    each = forward(once.dictionary.to_pylist(), pieces, model.logs)[:, once.indices.to_numpy()]
                    value[:, at + some] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some], axis=1)
            codes = coded.indices.to_numpy(zero_copy_only=False)
            bounds = off - off[0]
            best, sure = np.full(b.num_rows, count), np.zeros(b.num_rows)
            letters = np.concatenate(([0], np.cumsum(lettered[codes])))
            has = (letters[bounds[1:]] > letters[bounds[:-1]]) & (count > 0)
            if has.any():
                total = np.empty((count, b.num_rows))
                for i in range(count):
                    upto = np.concatenate(([0.0], np.cumsum(value[i][codes])))
                    total[i] = upto[bounds[1:]] - upto[bounds[:-1]]
                share = np.exp(total - total.max(axis=0))
                share /= share.sum(axis=0)
                best = np.where(has, share.argmax(axis=0), count)
                sure = np.where(has, share.max(axis=0), 0.0)
            yield pa.record_batch([*(b.column(c) for c in names), languages.take(pa.array(best)), pa.array(sure)],
                                  [*names, "lang_pred", "score"])
    return src.mapInArrow(run, schema)


def identify(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    return predict(docs, learn(docs, path)).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
