"""Small tables with what operators have to bear: nulls, empty and long texts, ties, repeats, clashing names."""

import random

import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, target double, words string,"
    " fingerprint long, n_words string, spans string, key string, h long, shard string, hash long, copies int, first long"
)
WORDS = ["the", "of", "and", "Größe", "été", "tion", "Ünd", "señal", "x1", "don't", "###", "ABC", "漢字", "end."]


def sentence(rng, count):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(count))


def make_rows():
    rng = random.Random(7)
    plain = [sentence(rng, rng.randint(1, 200)) for _ in range(60)]
    texts = [None, "", " \n\t ", "a", "a b c", "the\nthe\nthe\nthe"]
    texts += plain + plain[:10] + [plain[k] + " tail" for k in range(10, 20)]
    texts += [sentence(rng, 30_000), "token = abcdefgh " * 300, "zz " * 5000, "ab" * 40_000]
    rows = []
    for k, text in enumerate(texts):
        source = [None, "src1", "src0", "src0", "src0", "é"][k % 6]
        rows.append((k * 3 % 211, text, "en", source, None))
    rows.append(rows[8])  # a row twice
    rows.append((None, plain[3], None, "src0", 1))
    rows.append((None, None, None, None, None))
    rows.append((rows[9][0], "another text under a known id " * 9, "en", "src1", 2))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    clashing = (5, 0.5, "w", 1, "n", "s", "k", 2, "sh", 3, 4, 6)
    return spark.createDataFrame([row + clashing for row in rows], COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def ordered(values):
    return sorted(values, key=repr)


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """A folder of tables, as the registered queries read them."""
    place = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{place}/documents.parquet")
    texts = [(1, "The of and: GRÖSSE été tion"), (2, None), (3, "..."), (4, " ".join(f"w{k}" for k in range(20))), (None, "x1 don't")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    pages = [(k, f"http://h/{k}", ["<p>a</p>", "", None, "ü" * 9000, f"<b>{k}</b>"][k % 5]) for k in range(60)]
    pages += [(None, "u v\n", "<p>a</p>"), (5, None, "<i>other</i>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{place}/pages.parquet")
    return place
