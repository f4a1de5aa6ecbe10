import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with every awkward case: nulls, empty, blanks, copies,
    near copies, shared passages, repeated rows, a long text, extra columns."""
    rng = random.Random(5)
    syllables = "an ber cho dé el fi go hu ir ja ko lu mé no öp qu ra st tu vö".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def prose(n):
        out = []
        for i in range(n):
            w = word()
            out.append(w.capitalize() + "," if i % 11 == 3 else w + ".\n" if i % 13 == 12 else w)
        return " ".join(out)
    passage = prose(40)
    base = prose(120)
    near = base.split(" ")
    near[60] = "CHANGED"
    texts = [None, "", " \n\t ", "one", "two words", base, base, " ".join(near), base.upper(),
             passage + " " + prose(30), prose(30) + "\n" + passage, prose(5) + passage[:200],
             "a" * 200, "a" * 120 + "b" * 90, "x" * 60 + "\n" + "x" * 60, prose(2500),
             "é" * 70, "ñ" + "é" * 70, "日本語 text　with blanks and 123 it's <|endoftext|>",
             "Same line here today\nother\nSame line here today\n", "same LINE here today  \nand more\n\n",
             "\n\n\n", "word " * 80, prose(60) + " ### | *** %%%"]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s1")[i % 2], None if t is None else len(t), i * 2)
            for i, t in enumerate(texts)]
    rows += [(100 + i, prose(rng.randint(3, 90)), "en", "s0", 0, 7) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "n_words int").repartition(3)


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
