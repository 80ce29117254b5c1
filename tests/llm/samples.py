"""Documents the tests of this folder share."""

import random

SMALL = "/root/testdata/sf0.001"
# Names that the operators use themselves.
CLASHES = (
    "fp string, row_id string, _m string, score string, ids string, key string, part string, guest string, "
    "turn string, n_words string, labels string, features string, _row_number string, length string, start string"
)


def documents(spark, rows, clashes=True):
    """A table of documents from (doc_id, text), with further columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if clashes:
        schema = f"{schema}, {CLASHES}"
    extra = CLASHES.count(",") + 1 if clashes else 0
    full = [(d, t, None, "s", None, *["x"] * extra) for d, t in rows]
    return spark.createDataFrame(full, schema).repartition(3, "source") if full else spark.createDataFrame([], schema)


def _messy():
    """Null ids and texts, ties, repeated rows, odd characters and a long text."""
    turn = random.Random(4)
    words = ["".join(turn.choices("abcdeé", k=turn.randint(1, 5))) for _ in range(40)]
    prose = [" ".join(turn.choices(words, k=turn.randint(0, 90))) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(prose)]
    rows += [(None, None), (None, "x y"), (30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, "Two words")]
    rows += [(35, prose[0]), (35, prose[0]), (36, prose[1] + " tail"), (36, "tie"), (37, "▁ \x00  é😀\r\nÄ|#")]
    rows += [(38, " ".join(turn.choices(words, k=9000))), (39, "same " * 500), (None, prose[2])]
    return rows


MESSY = _messy()
