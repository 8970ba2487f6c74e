import random

import pytest


@pytest.fixture(scope="session")
def corpus(sf):
    """Texts of the smallest input with shared passages, repeats, near copies, and edge cases."""
    import pyarrow.parquet as pq

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()][:90]
    rnd, base = random.Random(7), list(rows)
    for i in range(30):
        a, b = rnd.choice(base)[1], rnd.choice(base)[1]
        at = rnd.randint(0, max(0, len(a) - 1))
        rows.append((2000 + i, b[: rnd.randint(0, 300)] + " " + a[at : at + rnd.randint(300, 1500)] + " " + b[-200:] + " x" * rnd.choice([0, 0, 300])))
    for i in range(20):
        words = rnd.choice(base[:6])[1].split()[:80]
        for _ in range(int(len(words) * rnd.choice([0.02, 0.05, 0.1]))):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        rows.append((3000 + i, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "a"), (5004, "A"), (5005, "ab " * 400), (5006, "ab " * 400 + "q"), (5007, base[3][1]), (5008, "é中😀" * 300), (5009, base[2][1].upper())]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with an extra column whose name clashes with results."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}", 1) for i, t in corpus], "doc_id long, text string, source string, n_removed int").repartition(3)
