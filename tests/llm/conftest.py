"""A small corpus with every odd case, and an empty one, as folders of Parquet tables."""

import random
import tempfile

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, ids array<int>, size string, id string, n_words int, h int, p int, shard int, start int, pii string, bands int, kept string"
PAGES = "page_id long, url string, html string, value string, first int, d string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, v string, ids int, score string"
LABELS = "doc_id long, quality int, toxic int"


def words(turn, n, kind="abcdefgh"):
    return " ".join("".join(turn.choice(kind) for _ in range(turn.randint(1, 9))) for _ in range(n))


def odd_texts():
    turn = random.Random(11)
    passage, other = words(turn, 120), words(turn, 300)
    near = other.split(" ")
    near[150] = "changed"
    texts = [None, None, "", "   \n\t ", "one", "two words", "one two three four", "one two three four five", "ONE two THREE four five", "\x00 nul\x0bwhite  ", "é" * 700, "a" * 1500, "ab" * 900]
    texts += [passage, passage, passage, other, " ".join(near), words(turn, 20) + " " + passage + " " + words(turn, 30), words(turn, 5) + passage[3:] + "é" + words(turn, 5)]
    texts += ["<|endoftext|>", " it's <|endoftext|>'s  \n x ", "don't we'll 're 12½ 中文字 😀😀 !!! ", words(turn, 40_000)]
    texts += ["mail a.b+c@ex-1.org. and @x y@ z@q ip 1.2.3.4 1.2.3.256 1.2.3.4.5 01.002.3.4 card 4539 1488-0343 6467 4539148803436468 call +1 (988) 555-2485, +12 later (988) 555-2485", "1" * 5000 + " +" + "1-" * 3000, "1.2.3." + "0" * 5000 + " 1.2.3.4.5.6.7.8.9 password: abcd1234efgh5678"]
    texts += ["\n".join(["same line", "same line", " ", "", "", "other #1 | x", "same line"]), "x y z " * 40, "|".join(["w"] * 300), words(turn, 60)]
    texts += [words(turn, turn.randint(1, 200)) for _ in range(40)]
    return texts


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    extra = ([1], "s", "i", 1, 1, 1, 1, 1, "p", 1, "k")
    rows = [(i, t, "en", "src", None if t is None else len(t), *extra) for i, t in enumerate(odd_texts())]
    rows += [rows[13], (900, None, None, None, None, *[None] * 11)]
    put(spark, folder, "documents", rows, DOCUMENTS)
    pages = [(0, "http://a/", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b/\r\nX: y", None), (3, "http://c/", ""), (4, "http://d/", "é" * 100_000), (5, "http://e/", "\x1f\x8b\x08 WARC/1.1\r\n\r\n"), (6, "u", "é" * 100_000), (6, "u", "é" * 100_000), (7, "u", "<p>x</p>")]
    put(spark, folder, "pages", [(*p, "v", 1, "d") for p in pages], PAGES)
    turn = random.Random(3)
    vectors = [(i, [turn.gauss(0, 1) for _ in range(8)]) for i in range(260)]
    vectors += [(i, [0.5] * 8) for i in range(300, 420)] + [(500, None), (501, []), (502, [1.0, None]), (550, [float("nan")] * 8), (551, [float("inf")] * 8), (600, [0.25] * 4), (None, [0.1] * 8), vectors[3], vectors[50]]
    put(spark, folder, "embeddings", [(i, v, 0, "v", 1, "s") for i, v in vectors], EMBEDDINGS)
    put(spark, folder, "labels", [(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, None), (7777, 0, 0)], LABELS)
    return folder


@pytest.fixture(scope="session")
def empty(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, schema in (("documents", DOCUMENTS), ("pages", PAGES), ("embeddings", EMBEDDINGS), ("labels", LABELS)):
        put(spark, folder, name, [], schema)
    return folder


@pytest.fixture(scope="session")
def documents(spark, odd):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()]
