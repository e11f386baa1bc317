import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "cloud", "maple", "harbor", "copper", "lantern"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + r.choice(["", "s", "ing", "ly"]) + (str(r.randrange(1000)) if r.random() < 0.3 else "")
        out.append(w.capitalize() if i % 11 == 0 else w + ("." if i % 11 == 10 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def docs(spark):
    """Ordinary, copied, tiny, empty, null, very long and repeated texts, with columns whose names clash with inner ones."""
    passage = prose(900, 70)
    leak = "the quick benchmark question asks which metal melts at the lowest temperature of all known elements today"
    rows = [(i, prose(i, 40 + 17 * i), "en" if i % 3 else "de", f"src{i % 2}") for i in range(12)]
    rows += [
        (20, prose(3, 40 + 17 * 3), "en", "src0"),  # an exact copy of 3
        (21, prose(5, 40 + 17 * 5).replace("river", "brook", 2), "en", "src1"),  # a near copy of 5
        (22, prose(31, 30) + " " + passage + " " + prose(32, 20), "en", "src0"),
        (23, passage + "\n" + prose(33, 25), "en", "src1"),
        (24, prose(34, 30) + ". " + leak.upper() + "! " + prose(35, 10), "en", "src0"),
        (25, "", "en", "src0"),
        (26, None, "en", "src0"),
        (27, "   \n ", None, None),
        (28, "word", None, "src1"),
        (29, prose(77, 30000), "en", "src0"),
        (30, " ".join(["again and"] * 200), "en", None),
        (31, "Überraschung é ñ 漢字   🙂 ok", "de", "src1"),
        (7, prose(7, 40 + 17 * 7), "en", "src1"),  # a repeated row
        (None, prose(3, 40 + 17 * 3), "en", "src0"),
    ]
    full = [(*r, len(r[1]) if r[1] is not None else None, 1, "x", -5, "h", 9) for r in rows]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        "start int, part string, removed_tokens int, hash string, keeper int"
    )
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [
        (1, "The quick benchmark question asks: which metal melts at the lowest temperature of all known elements, today?"),
        (2, "short one"),
        (3, None),
        (4, ""),
        (1, "The quick benchmark question asks: which metal melts at the lowest temperature of all known elements, today?"),
    ]
    return spark.createDataFrame(items, "item_id bigint, text string")


def empty_like(df):
    return df.sparkSession.createDataFrame([], df.schema)
