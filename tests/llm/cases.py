"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, odd characters, clashing columns."""

import random

TEXT_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, spans string, rank int, fp string, ids string"


def words(rng: random.Random, count: int, letters: str = "aeiourstn") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(count))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    plain = [words(rng, n) for n in (1, 2, 3, 4, 5, 40, 60, 60, 200, 3_000)]
    near = plain[8].split(" ")
    near[7] = "other"
    lines = "\n".join([plain[5], plain[5], "", "  ", plain[6], plain[5]])
    odd = ["", " ", "\n\t", "...", "12 34", "A b c d", "\x1c\x1d x", "Ünïcode ǅ ÉÉ ﬁ Σς", "中文字 日本語", "🙂🙂 a",
           "<|endoftext|> and <|startoftext|>", "it's we'll I'd 's", "a\x00b", "x" * 3_000, "tab\tand  two"]
    return [None, *plain, " ".join(near), plain[8], plain[8].upper(), lines, *odd, None, ""]


def rows(seed: int = 1) -> list[tuple]:
    """Documents with a null id, a repeated row, and values in columns that results also use."""
    out = [(i, t, ("en", "fr", None)[i % 3], f"src{i % 2}", None, 0.5, "no", "x", 1, "f", "i") for i, t in enumerate(texts(seed))]
    return [*out, out[9], (None, "without an id here", None, None, 3, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None, None, None)]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), TEXT_COLUMNS).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], TEXT_COLUMNS)


def as_bag(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
