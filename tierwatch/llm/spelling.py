"""Spelling variants: words at edit distance one, by PartEnum signatures.

    words       runs of letters, counted over the corpus (counts are partial
                before the shuffle: a word of a third of all runs is one row a
                task)
    vectors     a word's letter multiset is a binary vector, one dimension for
                each letter and occurrence; one inserted, deleted or replaced
                letter changes at most two of them
    partition   letters are dealt to CLASSES classes, so the dimensions are too
    enumerate   vectors that differ in two dimensions at most agree in all but
                two classes: each choice of the two that are left out gives one
                signature, the rest of the vector
    equi-join   words that share a signature meet, if they also share the length
                or differ by one, and share the first or the last half: of two
                words at edit distance one, one half is the same in both
    verify      by their edit distance; a pair counts where it first meets only

No near pair is lost, and there are no caps: equal parts of a vector have equal
codes (an accidental equality adds a candidate, which the verification ends).
Only verified pairs leave the join; its hot keys are left to Spark's skew join.

Defined results: null and empty texts have no words; a row without doc_id is
read as of an empty id; repeated rows count each; ties of n go to the word that
is smaller in code-point order; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
CLASSES = 4
PART = 64 // CLASSES          # bits of a class in the vector's code
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "[a-zÀ-ÿ]+"
# Letters in about the order of their frequency in European texts, then the
# accented ones: dealt in turn, so that classes are about equally full.
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz" + "".join(map(chr, range(0xC0, 0x100)))


def letter_runs(docs: DataFrame) -> DataFrame:
    """(doc_id string, run): every maximal run of letters, A-Z lower-cased."""
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                       F.explode(F.regexp_extract_all(lower, F.lit(_RUN), F.lit(0))).alias("run"))


def misspelt(doc_id: Column, run: Column, every: int) -> Column:
    """The run, or the run without one letter where ``every`` divides the hash
    of both: a stand-in for typing errors that needs no made-up text."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    spot = F.pmod(h, F.length(run).cast("bigint")).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substr(run, F.lit(1), spot), F.substr(run, spot + 2))).otherwise(run)


def word_counts(docs: DataFrame, every: int = 31) -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    word = misspelt(F.col("doc_id"), F.col("run"), every).alias("word")
    # a run one letter too short can't become a word: gone before the shuffle
    runs = letter_runs(docs).where(F.length("run") >= LEAST_LENGTH)
    return (runs.select(word).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


def class_codes(word: Column) -> Column:
    """The letter multiset as one long: PART bits a class, the code of the
    word's letters of that class in order."""
    letters = F.array_join(F.array_sort(F.split(word, "")), "")
    parts = [F.translate(letters, "".join(x for i, x in enumerate(_LETTERS) if i % CLASSES != c), "") for c in range(CLASSES)]
    codes = [F.shiftleft(F.pmod(F.xxhash64(p), F.lit(1 << PART)), PART * c) for c, p in enumerate(parts)]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), codes)


def _masks() -> list[int]:
    """Bits that stay when two classes are left out, as signed longs."""
    whole = (1 << PART) - 1
    out = []
    for i, j in combinations(range(CLASSES), 2):
        bits = sum(whole << PART * c for c in range(CLASSES) if c not in (i, j))
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def signatures(words: DataFrame) -> DataFrame:
    """(word, n, vector, key, omit, side, long): for each choice of two classes
    left out and each half of the word, as the longer (or equally long) and as
    the shorter word of a pair."""
    w = words.withColumn("vector", class_codes(F.col("word")))
    omit = F.array(*[F.struct(F.lit(k).alias("omit"), F.lit(m).cast("bigint").alias("mask")) for k, m in enumerate(_masks())])
    w = w.select("*", F.explode(omit).alias("o")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("long"))
    size = F.when(F.col("long"), F.length("word")).otherwise(F.length("word") + 1)
    half = F.floor(size / 2).cast("int")
    start, end = F.substr("word", F.lit(1), half), F.substr("word", F.length("word") - half + 1, half)
    sides = F.array(F.struct(F.lit(0).alias("side"), start.alias("half")), F.struct(F.lit(1).alias("side"), end.alias("half")))
    w = w.select("*", size.alias("size"), F.explode(sides).alias("h"))
    key = F.xxhash64("size", "o.omit", F.col("vector").bitwiseAND(F.col("o.mask")), "h.side", "h.half")
    return w.select("word", "n", "vector", key.alias("key"), "o.omit", "h.side", "long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words at edit distance
    one, each once."""
    sig = signatures(words)
    rest = [c for c in sig.columns if c != "key"]
    a, b = (sig.select("key", *[F.col(c).alias(f"{c}_{s}") for c in rest]) for s in "ab")
    col = F.col
    size = F.length("word_a")
    half = F.floor(size / 2).cast("int")
    apart = col("vector_a").bitwiseXOR(col("vector_b"))
    first = F.lit(len(_masks()))
    for k, m in reversed(list(enumerate(_masks()))):
        first = F.when(apart.bitwiseAND(F.lit(m).cast("bigint")) == 0, F.lit(k)).otherwise(first)
    once = ((first == col("omit_a")) & (col("omit_a") == col("omit_b")) & (col("side_a") == col("side_b"))
            & ((col("side_a") == 0) | (F.substr("word_a", F.lit(1), half) != F.substr("word_b", F.lit(1), half))))
    # the longer one, or the smaller of two equally long ones, stands on the left
    turned = (col("long_a") & ~col("long_b")) | (col("long_a") & col("long_b") & (col("word_a") < col("word_b")))
    met = a.join(b, "key").where(turned & once & (F.levenshtein("word_a", "word_b", 1) == 1))
    both = F.array(*[F.struct(col(f"word_{x}").alias("word"), col(f"n_{x}").alias("n"), col(f"word_{y}").alias("near"),
                              col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba")])
    return met.select(F.explode(both).alias("p")).select("p.*")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): the end of every word's chain of forms.  A form has at
    least RATIO times its word's n, so a chain has at most log(most) links;
    each round follows twice as many of them."""
    links = max(int(math.log(max(most, 1), RATIO)) + 1, 1)
    ends = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(math.ceil(math.log2(links)), 0)):
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = cut(ends.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return ends


def variants(docs: DataFrame, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = cut(word_counts(docs, every), "words")
    near = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    best = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(-F.col("best.n") >= RATIO * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.n") >= RATIO * F.col("n"), -F.col("best.n")).alias("form_n")), "variants")
    most = best.agg(F.max("n")).first()[0] or 1
    ends = roots(best.where("form is not null"), most)
    return best.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
