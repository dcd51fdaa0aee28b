import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    """n words that no other seed has in this order."""
    out, x = [], seed * 2_654_435_761 % 4_294_967_296
    for _ in range(n):
        x = (x * 1_664_525 + 1_013_904_223) % 4_294_967_296
        out.append(WORDS[x >> 27 if x >> 27 < len(WORDS) else (x >> 20) % len(WORDS)] + str((x >> 12) % 40))
    return " ".join(out)


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, shared passages, nulls, empty texts, repeated rows and odd columns."""
    base = prose(1, 120)
    passage = prose(2, 60)
    rows = [
        (0, base), (1, base), (2, base.replace(base.split()[60], "changed", 1)), (3, prose(3, 100)), (4, None), (5, ""),
        (6, prose(4, 40) + "\n" + passage + "\n" + prose(5, 30)), (7, prose(6, 50) + " " + passage), (8, "short text"),
        (9, "short text"), (10, passage + " Ünïcödé ✓ " + passage), (11, "!!!"), (12, prose(7, 3000)), (12, prose(7, 3000)),
        (None, prose(8, 30)), (14, "x" * 500), (15, "é" * 300), (20, prose(3, 100) + " more"),
    ]
    schema = "doc_id bigint, text string, row string, kept string, n_chars bigint"
    return spark.createDataFrame([(i, t, "a", None, len(t or "")) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
