"""Small documents with every awkward case: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part string"


def documents():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    line = lambda n=8: " ".join(word() for _ in range(n))
    texts = ["\n".join(line(r.randint(3, 14)) for _ in range(r.randint(1, 6))) for _ in range(60)]
    base = texts[0]
    texts += [base, base + " ", base.replace(" ", "\t"), base.upper(), None, "", " \n\t", "é" * 40, "one", "one two three", texts[3][:-1] + "z", texts[4] + "\n" + texts[5]]
    texts += ["x" + texts[6], texts[7] + "\n" + texts[7], " ".join(word() for _ in range(6000)), "a" * 3000]
    texts += [texts[1].replace("a", "b", 1), texts[1].replace("a", "b", 2)]
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}", None if t is None else len(t), 0.5, "p") for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, texts[8], None, "src1", None, None, None), (None, None, None, None, None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
