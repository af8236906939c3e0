"""Operators without SQL, and the pipeline, against plain Python versions."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from veilstream.llm import decontam, language, mixing, pii, quality, secretscan


def texts(spark) -> list[str]:
    rng = random.Random(7)
    bits = [
        "a",
        "Z",
        "9",
        "12",
        "4111 1111 1111 1111",
        ".",
        "@",
        "-",
        "+",
        " ",
        "(",
        ")",
        ":",
        "=",
        '"',
        "'",
        "password",
        "TOKEN",
        "api_key",
        "ApiKey",
        "AKIA",
        "AKIAABCDEFGHIJKL",
        "0123456789abcdef" * 2,
        "é",
        "😀",
        "\n",
        "255",
        "256",
        "_",
        "/",
        "%",
    ]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return made + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def luhn(s: str) -> bool:
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return sum(x if i % 2 == 0 else 2 * x // 10 + 2 * x % 10 for i, x in enumerate(d)) % 10 == 0


def digits(s: str) -> int:
    return len(re.sub("[^0-9]", "", s))


def sha(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def held(spans: list[tuple[str, int, int]], out: str) -> bool:
    return {f"{k}:{s}:{e}" for k, s, e in spans} <= set(out.split(","))


def test_base_of_secrets(spark):
    every = texts(spark)
    got = {r.doc_id: r for r in secretscan.digest(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(8)).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(every):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        spans = [(["assign", "access", "hex"][k], s, e) for s, k, e in sorted(found)]
        assert got[i].base_sha256 == sha(spans), t
        assert not spans or held(spans, got[i].spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(f[1] == k for f in found) for k in range(3)]


def test_base_of_personal_data(spark):
    every = texts(spark)
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(8)).collect()}
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= digits(v) <= 19 and luhn(v)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= digits(v) <= 15),
    }
    for i, t in enumerate(every):
        found = {k: [(k, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])] for k, (p, ok) in rules.items()}
        spans = [x for k in rules for x in found[k]]
        assert got[i].base_sha256 == sha(spans), t
        assert not spans or held(spans, got[i].spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [len(found[k]) for k in rules]


ITEM = "Which of these seven rivers crosses the largest number of borders before it reaches the sea, and in which year was that first measured by boat?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(n))
    junk = lambda: "\n".join("".join(rng.choice("*%$#!| 019") for _ in range(60)) for _ in range(8))
    rows = [(i, prose(6 + i % 9)) for i in range(60)] + [(100 + i, junk()) for i in range(40)]
    rows += [
        (200, rows[0][1]),
        (201, rows[0][1]),
        (202, rows[1][1] + " more"),
        (203, rows[2][1].replace(" ", " zz ", 1)),
        (204, prose(4) + "\n" + ITEM + "\n" + prose(3)),
        (205, prose(5) + '\ntoken = "q8Zt3LmX9aVw2RkP7dYc5"\n' + prose(2)),
        (206, None),
        (207, ""),
        (208, "two words"),
        (209, "two words"),
        (None, prose(5)),
    ]
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = [(i, t, "en", None if i == 3 else "big" if (i or 0) % 3 else "small", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(
        docs,
        "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(
        [(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 140],
        "doc_id long, quality int, toxic int",
    ).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def sets(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline_by_stage(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = before, docs
        assert name == "mixing" or docs.columns == columns
    text = lambda rows: {r[0]: r[1] for r in rows}

    before, after = seen["quality"]
    ids = {r.doc_id for r in after.collect()}
    assert {r[0] for r in before} - ids - {206, 207, 208, 209} == set(range(100, 140))

    before, after = seen["near_duplicates"]
    s = {i: sets(t) for i, t in text(before).items() if i is not None}
    root = {i: i for i in s}
    for i in sorted(s):
        for j in sorted(s):
            c = len(s[i] & s[j])
            if i < j and c and 100 * c >= 80 * len(s[i] | s[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    ids = {r.doc_id for r in after.collect()}
    assert ids == {i for i in s if root[i] == i} | {None} and not ids & {200, 201, 202, 203}

    before, after = seen["decontamination"]
    assert {r[0] for r in before} - {r.doc_id for r in after.collect()} == {204}

    before, after = seen["secrets"]
    redacted = {r.doc_id: r for r in after.collect()}
    assert redacted[205].text == text(before)[205].replace(
        'token = "q8Zt3LmX9aVw2RkP7dYc5',
        "<SECRET>",
    ) and redacted[205].n_chars == len(redacted[205].text)
    assert all(redacted[i].text == t for i, t in text(before).items() if i != 205)

    before, after = seen["mixing"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/secrets/*.parquet'")
    want = sorted(repr((r[0], r[1], r[2], r[4])) for r in con.execute(mixing.sql()).fetchall())
    assert sorted(repr((r.doc_id, r.source, r.n_tokens, r["pass"])) for r in after.collect()) == want
    assert sorted(
        repr(tuple(r)) for r in corpus_pipeline.run(spark, folder).drop("weight").collect()
    ) == sorted(repr(tuple(r)) for r in after.drop("weight").collect())


# --- added spans ------------------------------------------------------------------------------------------------------


def slide(value: str, width: int) -> float:
    best, width = 0.0, min(width, len(value))
    for i in range(len(value) - width + 1):
        part = value[i : i + width]
        best = max(best, -sum(part.count(c) / width * math.log2(part.count(c) / width) for c in set(part)))
    return best


def is_random(v: str) -> bool:
    """The classes, thresholds and allow-list of the scan, by plain loops."""
    listed = re.search("example|sample|dummy|placeholder|changeme|lorem|test", v, re.I)
    if re.search("[0-9]", v):
        joined = re.fullmatch(r"[A-Za-z]+([_/-][A-Za-z]+)*[_/=-]?[0-9]{1,4}", v)
        uuid = re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", v)
        if listed or uuid or joined or re.fullmatch("[0-9+/_=-]+", v) or len(set(v)) == 1:
            return False
        classes = [("[0-9a-fA-F]+", 24, 3.0), ("[a-z0-9]+", 20, 3.6), ("[A-Z0-9]+", 20, 3.6)]
        for pattern, width, least in classes:
            if re.fullmatch(pattern, v):
                return len(v) >= width and slide(v, width) >= least - 1e-9
        return bool(re.search("[A-Z].*[a-z]|[a-z].*[A-Z]", v)) and slide(v, 20) >= 3.7 - 1e-9
    if listed:
        return False
    if re.fullmatch("[a-z]+|[A-Z]+", v):
        return slide(v, 20) >= 3.7 - 1e-9
    words = re.sub(r"[+/_=-]++|(?<![A-Za-z])[a-z]++|(?<![A-Za-z])[A-Z]++(?![a-z])|[A-Z]{1,4}[a-z]{2,}+", "", v) == ""
    return not words and bool(re.search("[A-Z].*[a-z]|[a-z].*[A-Z]", v)) and slide(v, 20) >= 3.8 - 1e-9


def test_added_spans_of_secrets(spark):
    rng = random.Random(3)
    alphabets = [
        "0123456789abcdef",
        "abcdefghijklmnopqrstuvwxyz",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        "ab1",
        "0123456789-/",
    ]
    every = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(15, 70))) for a in rng.choices(alphabets, k=5)) for _ in range(150)]
    every += ["see test" + "q8Zt3LmX9aVw2RkP7dYc5", "src/main/java/org/x-1", "name_of_thing=1234", "x-_12 aaaaaaaaaaaaaaaaaaaaaaaa1", *texts(spark)]
    got = {
        r.doc_id: r.spans for r in secretscan.digest(
            spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(8)
        ).collect()
    }
    n = 0
    for i, t in enumerate(every):
        base = {tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s and not s.startswith("entropy")}
        want = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
            if not any(s <= m.start() and m.end() <= e for s, e in base) and is_random(m[0]):
                want.append(f"entropy:{m.start()}:{m.end()}")
        assert [s for s in got[i].split(",") if s.startswith("entropy")] == want, t
        n += len(want)
    assert n > 100


def test_entropy_of_a_long_candidate_is_quick(spark):
    import time

    rng = random.Random(4)
    d = spark.createDataFrame([(1, "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(100_000)))], "doc_id long, text string")
    secretscan.digest(d.where("doc_id = 2")).collect()  # compiled before
    began = time.perf_counter()
    assert secretscan.digest(d).first().spans == "entropy:0:100000"
    assert time.perf_counter() - began < 10  # a few hundred times that if it were quadratic


def test_added_spans_of_personal_data(spark):
    rng = random.Random(5)
    made = [
        "Jane.O'Neil+x@mail-host.example",
        "write (jane [at] example.org)",
        "fe80:0:0:0:1:2:3:abcd",
        "4111-1111-1111-1111",
        "4111.1111.1111.1111",
        "(988) 555-2485",
        "0049 30 1234567",
        "12345678901234567890",
        "no data here",
        "a@b",
        "id 123 456 7890 x",
        "card: 5500 0000 0000 0004",
    ]
    every = [" ".join(rng.choices(made, k=4)) for _ in range(120)] + texts(spark)
    d = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.found for r in pii.candidates(d).collect()}
    counts: dict[tuple, int] = {}
    for i, t in enumerate(every):
        base = {(x.start, x.end) for x in found[i] if x.base}
        want = [(k, m.start(), m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(pii.WIDE[kind][0], t)]
        want = [(k, s, e) for k, s, e in want if not any(b < e and s < f for b, f in base)]
        assert sorted((x.kind, x.start, x.end) for x in found[i] if not x.base) == sorted(want), t
        for x in found[i]:
            counts[x.kind, tuple(x.votes)] = counts.get((x.kind, tuple(x.votes)), 0) + 1
    listed = sorted((k, list(v), n) for (k, v), n in counts.items())
    w = pii.fit(listed, pii.estimate(listed)[0])
    right = {key: 1 / (1 + math.exp(-sum(w[3 * i + v] for i, v in enumerate(key[1])) - w[15 + key[0]])) >= 0.6 for key in counts}
    out = {r.doc_id: r.spans for r in pii.digest(d).collect()}
    added = 0
    for i, f in enumerate(found[k] for k in range(len(every))):
        want = sorted((x.kind, x.start, x.end) for x in f if x.base or right[x.kind, tuple(x.votes)])
        assert out[i] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        added += len(want) - sum(x.base for x in f)
    assert added > 20


# --- fields -----------------------------------------------------------------------------------------------------------


def marginals(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward-backward of one sequence, position by position, in logarithms."""
    n, s = emit.shape
    f, b = np.zeros((n, s)), np.zeros((n, s))
    f[0] = emit[0]
    for t in range(1, n):
        f[t] = [emit[t, j] + np.logaddexp.reduce(f[t - 1] + trans[:, j]) for j in range(s)]
    for t in range(n - 2, -1, -1):
        b[t] = [np.logaddexp.reduce(trans[i] + emit[t + 1] + b[t + 1]) for i in range(s)]
    z = f + b
    return np.exp(z - np.logaddexp.reduce(z, axis=1)[:, None])


def test_quality_by_document(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    for r in quality.score(docs.select("doc_id", "text"), model).collect():
        raw = (r.text or "").encode()
        x, n, _ = quality.lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        plain = [y for y in raw.split(b"\n") if y]
        assert n.tolist() == [len(y) for y in plain]
        assert np.allclose(
            x[:, 0] * n,
            [sum(65 <= c <= 90 for c in y) for y in plain],
        ) and np.allclose(x[:, 2] * n, [sum(48 <= c <= 57 for c in y) for y in plain])
        share = model.empty
        if len(x):
            zero = np.zeros_like(x[:1])
            full = np.hstack([x, np.vstack([zero, x[:-1]]), np.vstack([x[1:], zero])])
            share = (marginals(full @ model.weights, model.trans)[:, 1] * n).sum() / n.sum()
        assert abs(r.score - 1 / (1 + math.exp(-model.curve[0] * share - model.curve[1]))) < 1e-6, r.doc_id


def test_language_by_document_and_code_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    some = [r.text for r in docs.select("text").collect() if r.text][:40]
    by_lang = {r.lang: r.text for r in docs.where("length(text) between 300 and 3000").select("lang", "text").collect()}
    names = sorted(x for x in by_lang if x)
    mixed = [(a, b, f"{by_lang[a]}\n{by_lang[b]}") for a in names for b in names if a != b]
    for text in [*some, *(m[2] for m in mixed)]:
        raw = np.frombuffer(text.encode(), np.uint8)
        w = language.look(raw, np.array([0, len(raw)]), model.bits)
        p = marginals(model.emit(w)[w.type_of].astype(float), model.trans)
        share = (p * w.size[w.type_of][:, None]).sum(0)
        got, score = model.predict(raw, np.array([0, len(raw)]))
        assert got == [model.names[int(share.argmax())]] and abs(score[0] - share.max() / share.sum()) < 1e-6
    for a, b, text in mixed:
        # words before the switch are in one language, those after it in the other
        raw = np.frombuffer(text.encode(), np.uint8)
        w = language.look(raw, np.array([0, len(raw)]), model.bits)
        p = marginals(model.emit(w)[w.type_of].astype(float), model.trans)
        cut = len(re.findall(r"[^\x20\x09-\x0D]+", by_lang[a]))
        best = p.argmax(1)
        assert (best[:cut] == model.names.index(a)).mean() > 0.75 and (best[cut:] == model.names.index(b)).mean() > 0.75


# --- decontamination --------------------------------------------------------------------------------------------------


def nearest(item: str, text: str) -> int:
    """Fewest edits between item and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_against_plain_edit_distance(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (14, 18, 22, 26, 30, 20)]  # of 60 to 160 bytes
    items = [(i, x[:159]) for i, x in enumerate(items) if len(x) >= 60]

    def damaged(x: str, k: int) -> str:
        for _ in range(k):
            i = rng.randrange(len(x))
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("qrstuvwxyz") + x[i:], x[:i] + rng.choice("qrstuvwxyz") + x[i + 1 :]])
        return x

    docs = []
    for i, x in items:
        for k in range(0, 14):
            docs.append(
                " ".join(word() for _ in range(6)) + " " + damaged(x, k).upper().replace(" ", "  ", 1) + " " + " ".join(word() for _ in range(6))
            )
    docs += [" ".join(word() for _ in range(40)) for _ in range(20)] + ["=" * 5000, x[:100]]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {
        (r.doc_id, r.item_id): r.edits for r in decontam.matches(
            d,
            spark.createDataFrame([*items, (99, "=" * 900)], "item_id long, text string"),
        ).collect()
    }
    assert (len(docs) - 2, 99) in got
    for j, t in enumerate(docs[:-2]):
        low = re.sub(r"[\x20\x09-\x0D]+", " ", t.lower())
        for i, x in items:
            limit = len(x) * decontam.ERRORS // 100
            n = nearest(x.strip(), low)
            assert ((j, i) in got) == (n <= limit), (j, i, n, limit)
            assert (j, i) not in got or got[j, i] == n


def test_decontamination_with_runs(spark):
    """Runs of one character of several lengths, in passages and documents, beside other text."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    line = lambda n: f"{word()} {word()} " + rng.choice("=-") * n
    items = [(i, " ".join(line(rng.choice([0, 11, 12, 13, 30, 60])) for _ in range(3))[:150]) for i in range(12)]
    items = [(i, re.sub(" +", " ", x).strip()) for i, x in items]
    items = [(i, x) for i, x in items if len(x) >= 60]
    docs = []
    for _, x in items:
        for k in range(0, 12, 3):
            t = x
            for _ in range(k):
                j = rng.randrange(len(t))
                t = t[:j] + rng.choice(["", "z", t[j] * 2]) + t[j + 1 :]
            docs.append(f"{line(70)} {t} {line(25)}")
    docs += ["=" * 130_000, "-" * 50 + " " + "=" * 59]
    items += [(90, "=" * 32_000), (91, "=" * 60)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(2)
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.matches(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(len(docs) - 2, 90), (len(docs) - 2, 91), (len(docs) - 1, 91)} <= set(got)
    for j, t in enumerate(docs[:-2]):
        for i, x in items[:-2]:
            n = nearest(x, re.sub(" +", " ", t))
            assert ((j, i) in got) == (n <= len(x) * decontam.ERRORS // 100), (j, i, n)
