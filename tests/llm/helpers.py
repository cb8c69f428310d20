from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spaced(text: str | None, down: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(lower(text) if down else text)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def documents(spark, texts, **more):
    """A table like documents: ids from 0, source 's', lang 'en'; with clashing extra columns."""
    data = [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score int, kept string")


#: Texts that every operator must take.
ODD = [None, "", "   \n\t ", "one", "one", "!!! ... 123", "é ü ñ", "\x00 \x1c a b", "word " * 3000, "word " * 3000, "A b C d E f " * 40, "x" * 20000]


#: Columns named like the operators' own helpers, as a user's table may have them.
CLASHES = ("_source _n _shard _order _end key row n size taken spans _name name _th1 th1 th2 blank _lang_pred pred score _lang_score _pass pass cut group cid comp k n_words ids rid fps").split()


def clashing(spark, texts):
    """Documents with a column of each name in CLASHES that holds its own name and the row's number."""
    data = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), *[f"{c}-{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
