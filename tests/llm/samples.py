"""Rows with all edges that the operators must take."""
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score double, tags map<string,string>"
WORDS = "the of and river stone light under seven quiet morning garden window paper letter bridge winter".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 16) % 3 else str((x >> 4) % 50)))
    return " ".join(out)


def rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, columns named like results."""
    long = sentence(1, 30000)
    texts = [(1, sentence(2, 40)), (2, sentence(2, 40)), (2, sentence(2, 40)), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long + " end"), (8, "a b"),
             (9, "A b"), (10, sentence(3, 60)), (11, sentence(3, 60).replace("river", "River") + " more"), (None, sentence(2, 40)), (None, None), (12, "é " * 50), (13, "x" * 5000)]
    return [(i, t, None if k % 5 == 0 else "en" if k % 2 else "fr", None if k % 4 == 0 else f"s{k % 3}", None, True, 0.5, {"a": "b"}) for k, (i, t) in enumerate(texts)]
