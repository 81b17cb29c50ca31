"""Small documents with every awkward case."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("lost", "n_lines", "n_dropped", "block", "row", "p", "fingerprint", "component_id", "words", "hits", "score", "terms", "bucket", "votes", "found", "size")

WORDS = "der die das und ein house tree river stone light green walk under table where again never many people small great".split()


def docs_table(spark, rows):
    """Rows (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("kept") for c in CLASHING})


def awkward(seed: int = 1, n: int = 60):
    """Rows with nulls, empty and blank texts, copies, near copies, repeated rows, ties, long texts and odd characters."""
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    rows = [(i, text(rng.randrange(1, 80)), rng.choice(["en", "de"]), rng.choice(["a", "b", None])) for i in range(n)]
    base = text(60)
    rows += [(1000 + i, base, "en", "a") for i in range(4)]
    words = base.split()
    rows += [(1100 + i, " ".join(words[:i] + ["changed"] + words[i + 1 :]), "en", "b") for i in range(3)]
    rows += [(2000, None, None, None), (2001, "", "en", "a"), (2002, "  \n\t ", "en", "a"), (2003, "12345 !!", "en", "b"), (None, base, "en", "a"), (None, None, None, "a"), (None, text(20), "de", "b")]
    rows += [(3000, text(3000), "en", "b"), (3000, text(10), "en", "b"), (3001, text(5), "en", "b"), (3001, text(5), "en", "b"), (3002, "é 😀 ß Ünïcode " * 30, "de", "b")]
    return rows
