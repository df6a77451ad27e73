import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copy string, shard string, covered string, `key` string, rank string, words string"
#: And names of what the operators return.
DOCS += "".join(f", {c} string" for c in "held_out lang_pred component_id fingerprint sequence_id offset score base_score kept taken licenses slot source_size __fp __row __key __text n bands".split())
OTHERS = DOCS.count(",") - 4


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves; a row is (id, text[, lang[, source]])."""

    def make(rows):
        full = []
        for r in rows:
            i, text, lang, source = (*r, *[None] * (4 - len(r)))
            full.append((i, text, lang, source, None if text is None else len(text), "s", "c", "h", *["x"] * (OTHERS - 3)))
        return spark.createDataFrame(full, DOCS)

    return make


WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(n, seed=0):
    """n words, by a simple generator."""
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x >> 8 & 15] + str(x >> 16 & 63))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    a, b = prose(60, 1), prose(80, 2)
    return [
        (1, a, "en", "s1"),
        (2, a, "en", "s1"),
        (2, a, "en", "s1"),
        (2, b, "fr", None),
        (3, None, "en", "s2"),
        (4, "", None, "s2"),
        (5, " \t\r\n\x0b\x0c ", "de", "s2"),
        (None, b, None, None),
        (None, None, None, None),
        (6, "one", "en", "s1"),
        (7, prose(30_000, 3), "de", "s3"),
        (8, "line\n" * 500, "de", "s3"),
        (9, "  é日本\U0001f600 x", "fr", "s3"),
    ]
