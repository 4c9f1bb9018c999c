"""Small tables with everything that operators must bear."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def hard_rows(seed: int = 1, n: int = 24) -> list[tuple]:
    """Null and empty texts, copies, near copies, shared lines and passages, one long text, repeated rows, a null id."""
    rng = random.Random(seed)
    shared_line, passage = words(rng, 8), words(rng, 90) + "."
    base = [words(rng, rng.randint(5, 160)) for _ in range(n)]
    rows = [(i, t + "\n" + shared_line if i % 4 == 0 else t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, f"{words(rng, 6)}. {passage}\n{words(rng, 9)}", "fr", "s0", None) for i in range(4)]
    for i in range(4):
        w = base[3].split()
        w[(5 * i) % len(w)] = "changed"
        rows.append((200 + i, " ".join(w), None, "s1", 1))
    rows += [(300, base[5], "en", None, 2), (301, base[5].upper(), "en", "s2", 2), (302, None, "en", "s2", None), (303, "", "de", "s2", 0), (304, " \t\n ", "de", "s2", 4)]
    rows += [(305, "é" * 300 + " " + words(rng, 40), "fr", "s2", 1), (306, words(rng, 9000), "en", "s1", 1), (307, "one", "en", "s1", 3), (307, "one", "en", "s1", 3)]
    rows += [(308, "orre " * 700, "en", "s1", 1), (None, base[5], "en", "s1", 1), (None, None, None, None, None)]
    return rows


def table(spark, rows: list[tuple], extra: bool = False):
    """extra: with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(7).alias(c) for c in ("n", "h", "rep", "component", "kept", "n_lines", "score", "label", "p", "spans", "key", "id", "value", "slot__", "lost_id__", "gone__", "places__", "row", "item", "odd.name")])
    return df
