"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilstream.llm import ann, decontam, language, lm, mixing, pii, quality, secretscan, warc
from veilstream.llm.minhash import near_duplicates, one_of_each

PROSE = "The river carried the old boat past seven quiet villages before it reached the wide grey sea in the evening."
LONG = " ".join(f"word{i % 4093} line{i % 977}" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a"),
    (1, PROSE, "en", "a"),  # an identical row
    (2, PROSE.upper(), "en", "a"),
    (3, None, None, None),
    (3, "another text of the same number, with its own words and nothing else in common", "en", None),
    (4, "", "en", "b"),
    (4, "", "en", "b"),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "c"),
    (7, "x" * 200_000, "de", "c"),
    (8, "mail a@b.org or 4111 1111 1111 1111, password = hunter2hunter2\n" * 3, "de", "c"),
    (None, "a row without a number, which has some words of its own as well", "fr", "d"),
    (None, None, "fr", None),
]
CLASHES = [
    "score",
    "n_tokens",
    "base",
    "spans",
    "key",
    "node",
    "component",
    "group",
    "at",
    "n",
    "kept",
    "pass",
    "weight",
    "label",
    "quality",
    "item_id",
    "u",
    "v",
    "error",
    "bucket",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(1, 0), (None, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE), (1, PROSE), (2, PROSE), (3, None), (4, "a"), (5, "x" * 400)], "item_id long, text string")


def run(name, docs, labels, benchmark):
    return {
        "op1": lambda: near_duplicates(docs, 3, 85),
        "op3": lambda: mixing.mix(docs),
        "op5": lambda: quality.classify(docs, labels),
        "op6": lambda: pii.digest(docs),
        "op7": lambda: language.identify(docs),
        "op8": lambda: secretscan.digest(docs),
        "op9": lambda: lm.score(docs),
        "op10": lambda: decontam.matches(docs, benchmark),
    }[name]()


NAMES = ["op1", "op3", "op5", "op6", "op7", "op8", "op9", "op10"]


def rows(df):
    return sorted(repr(r.asDict()) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows_and_clashing_columns(docs, labels, benchmark, name):
    got = rows(run(name, docs, labels, benchmark))
    clashing = docs.withColumns({c: F.lit("clash") for c in CLASHES})
    assert rows(run(name, clashing, labels.withColumn("text", F.lit("clash")), benchmark.withColumn("doc_id", F.lit(1)))) == got
    if name in ("op1", "op5", "op6", "op7", "op8"):
        assert len(got) == len(ROWS)
    if name == "op9":
        assert len(got) == 9  # rows of a number are one document


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, labels, benchmark, name):
    assert run(name, docs.limit(0), labels, benchmark).count() == 0
    if name == "op5":
        assert run(name, docs, labels.limit(0), benchmark).count() == len(ROWS)
    if name == "op10":
        assert run(name, docs, labels, benchmark.limit(0)).count() == 0


def test_near_duplicates_of_repeated_numbers(spark):
    a, b = PROSE, " ".join(f"other{i}" for i in range(30))
    d = spark.createDataFrame(
        [(7, a), (7, b), (3, b), (None, a), (None, "alone in the world with nobody like it"), (9, a + " x")],
        "doc_id long, text string",
    )
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(d, 3, 85).collect())
    assert got == [
        ("3", 28, "3", True),
        ("7", 18, "7", True),
        ("7", 28, "3", False),
        ("9", 19, "7", False),
        ("None", 6, "None", True),
        ("None", 18, "7", False),
    ]
    left = one_of_each(d.withColumn("at", F.lit(1)), 3, 85)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("3", b), ("7", a), ("None", "alone in the world with nobody like it")]


def test_one_of_each_drops_identical_rows(docs):
    got = sorted((r.doc_id or 0, len(r.text or "")) for r in one_of_each(docs).collect())
    assert [g for g in got if g[0] == 1] == [(1, len(PROSE))] and (2, len(PROSE)) not in got
    assert len([g for g in got if g[0] in (4, 5)]) == 3  # rows without words all stay
    assert one_of_each(docs.limit(0)).count() == 0 and one_of_each(docs).columns == docs.columns


def test_stages_on_edge_rows(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.where("item_id <> 4").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.withColumn("key", F.lit(1)), str(tmp_path))
        found = out.collect()
        assert name == "mixing" or out.columns == [*docs.columns, "key"]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name == "decontamination":
            assert {r.doc_id for r in found} >= {3, 4, 5, 6, 8, None} and not {r.doc_id for r in found} & {1, 2, 7}
            assert sum(r.doc_id is None for r in found) == 2 and sum(r.doc_id == 4 for r in found) == 2
        if name == "secrets":
            assert len(found) == len(ROWS) and any("<SECRET>" in (r.text or "") for r in found)


def test_decontamination_of_rows_without_number(spark, benchmark):
    d = spark.createDataFrame([(None, f"before {PROSE} after"), (None, "clean"), (1, f"x {PROSE}"), (1, "clean too")], "doc_id long, text string")
    assert sorted(r.text for r in decontam.clean(d, benchmark.where("item_id = 1")).collect()) == ["clean", "clean too"]


def test_warc_edges(spark):
    big = "é" * 200_000
    rows_ = [
        (1, "u", big, 9),
        (2, None, big, 9),
        (2, None, big, 9),
        (3, "a\r\nb c", "", 9),
        (4, "u", None, 9),
        (None, "u", "no number", 9),
        (5, "u", "x" * 100, 9),
        (6, "u", "x" * 100, 9),
    ]
    pages = spark.createDataFrame(rows_, "page_id long, url string, html string, digest int").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to), r.error) for r in warc.round_trip(pages).collect())
    assert got == [
        ("1", 400_000, "response", "None", None),
        ("2", 400_000, "revisit", "1", None),
        ("2", 400_000, "revisit", "1", None),
        ("3", 0, "response", "None", None),
        ("4", 0, "response", "None", None),
        ("5", 100, "response", "None", None),
        ("6", 100, "revisit", "5", None),
        ("None", 9, "response", "None", None),
    ]


def test_ann_edges(spark):
    x = np.random.default_rng(1).normal(size=(50, 4))
    rows_ = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows_ += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(100, 140)]  # copies, hence ties
    rows_ += [(i, [float(i), 2.0]) for i in range(200, 206)]  # another length
    rows_ += [(300, [1.0, None, 0.0, 0.0]), (301, None), (302, []), (303, [float("inf")] * 4), (None, [1.0] * 4), (0, [9.0, 9.0, 9.0, 9.0])]
    table = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").withColumns(
        {"id": F.lit(1), "score": F.lit(2), "v": F.lit(3)}
    ).repartition(3)
    got = {}
    for r in sorted(ann.nearest(table, every=20, k=5).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    vectors = {}
    for i, v in rows_:
        if i is not None and v and all(a is not None and np.isfinite(a) for a in v):
            vectors[i] = min(vectors.get(i, v), v)
    for q in (i for i in vectors if i % 20 == 0):
        near = sorted(
            (-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])
        )
        assert got[q] == [i for _, i in near[:5]]
    assert ann.nearest(table.limit(0)).count() == 0 and ann.nearest(table.where("vec_id = 20")).count() == 0


def test_hash_of_structured_words():
    """Texts whose polynomial hashes modulo 2^64 agree for every base."""
    import pyarrow as pa

    from veilstream.llm.textnum import slices, word_hashes

    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word[:60], word[:60].translate(str.maketrans("ab", "ba")), "a" * 64, "a" * 65]
    hashes = [int(word_hashes(raw, at)[0][0]) for t in texts for _, raw, at in slices(pa.array([t]))]
    assert len(set(hashes)) == len(texts)
