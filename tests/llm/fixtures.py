"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

CLASHES = {"n": 1, "size": 2, "key": "k", "component_id": 9, "kept": False, "score": 0.5, "lang_pred": "xx", "target": 3.0, "text_": "t", "hashes": "h", "lines": "l"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'long'}" for k, v in CLASHES.items())


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = [f"{'aeiou'[i % 5]}{'bcdfg'[i // 5 % 5]}{i}x" for i in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text, lang, source)."""
    long_ = prose(20_000, 1, 5000)
    base = prose(300, 2)
    near = base.split()
    near[17] = "changed"
    line = "A shared line that is certainly longer than forty characters."
    rows = [
        (1, long_, "en", "a"), (2, base, "en", "a"), (3, base, "de", "b"), (4, " ".join(near), "en", "b"), (5, None, None, None), (6, "", "en", "a"),
        (7, "word", "fr", None), (8, "word", "fr", "c"), (9, " \t\n ", "en", "a"), (10, "!!! 123 ???", "de", "a"), (None, "no id " + base, "en", "a"), (None, None, None, None),
        (20, base, "en", "a"), (20, base, "en", "a"), (30, prose(50, 3) + "\n" + line, "en", "a"),
    ]
    rows += [(40 + i, prose(30, 100 + i) + f"\n  {line.upper() if i % 2 else line}\t\nown line {i}", "en", "abc"[i % 3]) for i in range(8)]
    rows += [(60, "ünïcödé ß 日本 " + base[:500], "de", "b"), (61, "x" * 5000, "en", "b"), (62, "ab" * 2000, "en", "b")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(*r, len(r[1] or ""), *CLASHES.values()) for r in rows], SCHEMA)


def write(spark, tmp_path, rows=None, **tables) -> str:
    documents(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


class Union:
    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, x: int) -> int:
        while self.p[x] != x:
            self.p[x] = self.p[self.p[x]]
            x = self.p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)
