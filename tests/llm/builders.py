"""Small tables with the awkward cases: nulls, empty and long texts, copies, repeats, extra columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = ("stone river light cloud winter paper garden silver window market letter bridge forest candle"
         " summer travel engine corner mirror thunder").split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n)).capitalize() + "."


def paragraph(rng, n):
    return " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(n))


def documents(seed=1, n=30):
    """Rows (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(seed)
    shared = paragraph(rng, 8)
    texts = [paragraph(rng, rng.randint(1, 12)) for _ in range(n)]
    texts[3] = texts[2]
    texts[5] = texts[4] + " " + shared
    texts[6] = shared + " " + texts[7]
    texts[8] = "a" * 700
    texts[9] = "é" * 300
    texts[10] = " ".join(rng.choice(WORDS) for _ in range(20_000))
    texts[11], texts[12], texts[13] = "", None, " \n\t "
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[11], (None, texts[2], None, None, None), (None, None, None, None, None)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    """The table with extra columns named like columns that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("fp", "h", "key", "row", "position", "cell", "blob", "place", "range", "epoch", "score", "digest"):
        df = df.withColumn(name, F.lit("x"))
    return df
