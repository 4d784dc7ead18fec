"""Brute-force versions and fixtures shared by the tests of this folder."""

from __future__ import annotations

import random

from pyspark.sql import types as T

CLASHES = ["_kept", "kept_", "member", "_member", "pivot", "key", "size", "row", "words", "lines", "spans", "base", "kept", "n", "node", "keys", "hits", "uid", "unit", "part", "chunk", "score", "length", "at", "_t", "text_", "failed"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])


def prose(r: random.Random, n: int) -> str:
    parts = ["the", "an", "or", "in", "er", "on", "st", "tion", "wh", "ble", "hé", "ç"]
    out = []
    for i in range(n):
        w = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out) + "."


def edge_rows() -> list[tuple]:
    r = random.Random(9)
    base = prose(r, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = {
        0: base, 1: None, 2: "", 3: " \n\t ", 4: base, 5: near, 6: "one two", 7: "one two", 8: prose(r, 6000), 9: "mail a.b@c.example.com or +1 (017) 555-7713, 1.2.3.4; 4111 1111 1111 1111 " + prose(r, 80),
        10: "x" * 5000, 11: prose(r, 90) + "\n" + "a | b | c | d | e\n" * 40, 12: " odd \x1c space\xa0here <|endoftext|> " + prose(r, 60), 13: prose(r, 30) + " " + base[100:300] + " " + prose(r, 30),
    }
    extra = [f"v{i}" for i in range(len(CLASHES))]
    rows = [(i, t, "en", "s", len(t or ""), *extra) for i, t in texts.items()]
    return [*rows, rows[0], (None, "no id here at all", None, None, None, *[None] * len(CLASHES))]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def duplicate_components(texts: dict, width: int) -> dict:
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                s = len(sets[a] & sets[b])
                if 100 * s >= 80 * (len(sets[a]) + len(sets[b]) - s):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
