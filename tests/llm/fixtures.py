"""Small tables with the awkward cases: nulls, empty and long texts, copies."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORDS.findall(text or "")


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "river", "stone", "light", "Über", "kept", "no", "one"]) + str(rng.randrange(400)) for _ in range(n))


def corpus(seed=0, n=60):
    """(doc_id, text) rows: prose, exact and near copies, shared passages, junk."""
    rng = random.Random(seed)
    passage = prose(rng, 50)
    rows = []
    for i in range(n):
        text = prose(rng, rng.choice([1, 3, 5, 8, 30, 90, 200]))
        if i % 5 == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif i % 5 == 2 and rows:
            w = words_of(rows[rng.randrange(len(rows))][1])
            for _ in range(max(1, len(w) // 40)):
                if w:
                    w[rng.randrange(len(w))] = "changed" + str(rng.randrange(9))
            text = "  ".join(w)
        elif i % 5 == 3:
            text = text + "\n" + passage + "\t" + prose(rng, 4)
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "a"), (n + 4, "x " * 3000), (n + 5, prose(rng, 5000)), (n + 6, "  nbsp İı KK")]
    return rows


def frame(spark, rows):
    """The rows as documents with columns whose names clash with common helpers'."""
    wide = [(i, t, None, None, None, 7, 8, "z") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, chunk int, part int, words string")
