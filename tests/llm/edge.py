"""Documents with everything that operators must bear, and plain versions of what they compute."""

from __future__ import annotations

import random
import re

BLANK = "[\x20\x09-\x0d]+"
#: Columns that operators use inside; a table may have them too.
CLASHES = "pos n c key h1 same value fp hash cell group part word at score row n_lines kept found other twice rejected"
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} int" for x in CLASHES.split())


def rows() -> list[tuple]:
    draw = random.Random(3)
    word = lambda: "".join(draw.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(draw.randint(1, 4)))
    prose = [" ".join(word() for _ in range(draw.randint(5, 60))) + "." for _ in range(40)]
    texts = [
        None, "", " \n\t ", "\n\n", "x", "İstanbul Straße naïve café áb", "日本語 テキスト 12 kg", "<|endoftext|> <|startoftext|>x <|ENDOFTEXT|>",
        "it's they'll we've 'd", "a" * 30_000, "long line of words " * 4000, *prose, *prose[:5], prose[0] + "\n" + prose[1], prose[1].upper() + "\n" + prose[0],
        "  " + prose[2] + "\t\n" + prose[3] + "\nshort\nshort", "short\nshort", "Same line of text here\nSame line of text here", "same LINE of text here ",
    ]
    out = [(i * 3, t, ["en", None, "de"][i % 3], ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    out += [out[12], out[12], (out[13][0], "another text with an old id", "en", "a"), (None, prose[4], "en", None), (None, None, None, None)]
    return out


def frame(spark, some: list[tuple] | None = None):
    some = rows() if some is None else some
    return spark.createDataFrame([(*r, *[7] * len(CLASHES.split())) for r in some], SCHEMA).repartition(3)


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return [w for w in re.split(BLANK, lower(text)) if w]


def order(value) -> tuple:
    """Sorts rows whatever nulls they hold."""
    return tuple((x is not None, x) for x in value)
