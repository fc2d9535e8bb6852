import random

import pytest

#: Texts that operators must survive: null, empty, white space, one word, long, repeated, unusual characters.
ODD = [None, "", " \t\n", "word", "x" * 5000, "the " * 3000, "no\x00bell \u0301 e\u0301 \U0001f600 日本語 \x85 \xa0", "a\n\na\n\n", "<|endoftext|> </turn> \\ | ### "]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with every odd text, null and repeated ids, null sources, and columns with names that operators use inside."""
    rows = [(i, t, "en", f"s{i % 3}", 0 if t is None else len(t), "row", 1) for i, t in enumerate(ODD)]
    rows += [(None, "a null id", None, None, 9, "row", 2), (3, "word", "en", "s0", 4, "row", 3), (3, "word", "en", "s0", 4, "row", 3), (4, "another text of an id", "en", None, 21, "row", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, kept int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    """A small corpus: prose, junk, exact and near copies, pages, labels and conversations."""
    r, folder = random.Random(11), tmp_path_factory.mktemp("sf")
    common = "the of and to a in is that".split()
    word = lambda: r.choice(common) if r.random() < 0.35 else "".join(r.choice(("ba", "ne", "ti", "lor", "um", "es")) for _ in range(r.randint(1, 4)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n // 9 + 1)) + "."
    texts, labels = [], []
    for i in range(120):
        kind = i % 6
        if kind == 5:
            text = r.choice([" ".join(w + "***" for w in prose(90).split()), prose(90).upper().replace(" ", "!! "), " ".join(w for w in prose(30).split() for _ in range(4))])
        elif kind == 4 and i > 20:
            words = texts[i - 14 - i % 2].split()
            for _ in range(max(1, len(words) // 40) if i % 12 == 4 else 0):
                words[r.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = prose(r.randint(60, 260))
        texts.append(text)
        labels.append((i, 0 if kind == 5 else 1, 0))
    docs = [(i, t, "en", "big" if i % 3 else f"s{i % 5}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    hosts = ["a.com", "example.com", "www.example.com", "x.net", "y.org", "deep.y.org"]
    pages = [(i, None if i == 7 else f"http{'s' * (i % 2)}://{r.choice(hosts).upper() if i % 9 == 0 else r.choice(hosts)}{r.choice(['/en/', '/es/', '/fr/', '/', ''])}{r.choice(['', 'p' + str(i), '?q=/en/'])}", None if i == 3 else f"<p>{texts[i % 17]}</p>" if i % 4 else "") for i in range(150)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{folder}/pages.parquet")
    return str(folder)
