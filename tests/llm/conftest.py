import random

import pytest

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages and odd ones."""
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (3, 8, 30, 60, 120, 200, 400)]
    passage = sentence(rng, 60)
    near = base[5].split()
    near[100] = "changed"
    lines = [sentence(rng, 8) for _ in range(6)]
    return [
        *base,
        base[4],
        base[4],
        " ".join(near),
        "x " + passage + " y",
        "other start " + passage + " and end",
        "\n".join(lines),
        "\n".join([*lines[2:5], "own line", *lines[:2]]),
        None,
        "",
        "   \n\n \t",
        "Ünïcödé ßtraße İstanbul ΑΣ ΟΔΟΣ 日本語 テキスト 😀 <|endoftext|> a.b,c ... !?",
        "a\x0bb\x1cc\x85d\xa0e\x00f",
        "na" * 3000,
        "Released under the MIT License.\nAll rights reserved.",
    ]


@pytest.fixture
def docs(spark, texts):
    """Documents with clashing extra columns, a repeated row and a null id."""
    rows = [(i * 3, t, "en" if t and i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[3], None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["score", "lang_pred", "spans", "items", "n_words", "record", "size", "shard", "slot", "node", "band", "start", "gone", "lines", "bucket", "draw", "part", "n"]
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in extra)).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
