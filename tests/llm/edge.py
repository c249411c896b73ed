"""Tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

LONG = " ".join(f"word{i % 7919} other{i % 104729}" for i in range(60_000))
PERSONAL = "write to a.b+c@mail-1.example.com_x@y.org, 10.0.0.255, 4111 1111 1111 1111 or +1 (212) 555-1234"
ASTRAL = "😀 𝔘𝔫𝔦 a@b.co 😀 ünï x1.2.3.4 " * 3
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "n_words int, kept string, spans string, size string, copy string, fp string, `row` string, measured string"
)


def rows() -> list[tuple]:
    texts = [
        (1, "A first text of some few words, which says little but says it in more than twenty words in all, so it stays."),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, LONG),
        (5, LONG),
        (6, LONG + " end"),
        (None, "a row without a number"),
        (8, PERSONAL),
        (9, ASTRAL),
        (10, "same line\n" * 40),
        (11, "one"),
        (12, "One"),
    ]
    out = []
    for i, (key, text) in enumerate(texts):
        source = [None, "b", "a", "é"][i % 4]
        n = None if text is None else len(text)
        out.append((key, text, None if i % 3 == 0 else "en", source, n, i, "x", "y", "z", None, "f", "r", None))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def save(spark, folder, df):
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
