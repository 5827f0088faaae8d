import random

import pytest

WORDS = "the of and to in red blue tree house river stone cloud walk seven candle morning".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) if r.random() < 0.7 else r.choice(WORDS) for _ in range(n))


def texts() -> list[str | None]:
    """Whole range of shapes: null, empty, blank, short, copies, near copies, long, odd characters."""
    a, b = prose(1, 300), prose(2, 60)
    near = a.replace(" tree", " Tree", 1)
    return [
        None, "", " \t\n", "one", "One two\x0bthree", a, a, near, b, f"{b} extra", prose(3, 6000),
        "Ärger ÉCOLE straße niño 日本語 😀 \x00 end", "word " * 400, "line one here\nline one here\n\nother\nline one here",
        f"{prose(4, 30)} {b} {prose(5, 30)}", prose(6, 12),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with clashing extra columns, a null id and a repeated row."""
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts())]
    rows += [rows[5], (None, texts()[8], "en", "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = (
        "id text_key words row n_words term shard score fp __id __key __spans __hash __text_hash stays marks last "
        "marked_id Marked_Key judged_id judged_hash text_hash component query rep bucket n"
    )
    clash = {c: df["doc_id"] * 0 for c in names.split()}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
