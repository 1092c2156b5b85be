"""Awkward documents and pages for the operator tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, __row string, digest int, length int"


def words(seed: int, count: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(count))


def texts() -> list:
    """Nulls, empty and blank texts, very long ones, ties and copies, other alphabets, odd white space."""
    base = [words(i, 60) for i in range(12)]
    long = words(99, 9000)
    return [
        None, "", " ", "\t\n\x0b\x0c\r ", "x", base[0], base[0], base[0] + " ", base[1], base[1][:-1], long, long + "!",
        words(3, 30) + " " + base[2] + "\n" + base[2], base[3] + "\u00a0\u2003z\x1c é", "ünï €uro \U0001f600 " * 9, "a" * 3000, "\x00\x00a\x00",
        "password= hunter2secret token:abc", "line one\nline one\n\nline one\n" + base[4], "\n\n  two  blanks \n", "<|endoftext|>" + base[5],
        *base[5:], "don't we'll  'S 12 3x", "### $$$ %%% " * 20, "Pfpfte " * 200,
    ]


def rows() -> list:
    out = []
    for i, text in enumerate(texts()):
        out.append((i, text, ("en", None, "de")[i % 3], None if i % 7 == 0 else f"s{i % 2}", 1, "clash", "clash", 7, -1))
    # Repeated rows, a repeated id with another text, null ids.
    out += [out[5], out[5], out[0], (5, "other", "en", "s0", 1, "clash", "clash", 7, -1), (None, out[8][1], "en", "s0", 1, "c", "c", 7, -1)]
    out += [(None, None, None, None, None, None, None, None, None)] * 2
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def raw(text) -> bytes:
    return (text or "").encode()
