"""Every stage against its plain version, each on the rows the one before kept."""

import random

import pytest
import tiktoken
import public_tokenizers

import corpus_pipeline
from tallyward.llm import bpe
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_simhash import classes, plain_fingerprint
from tests.llm.test_suffix_dedup import brute as passages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    random.seed(21)
    words = {"en": "the cat sat on that mat with this dog and there".split(), "de": "der hund und die katze sind nicht in dem haus".split()}
    make = lambda lang, k: " ".join(random.choice(words[lang]) + random.choice(["", "", chr(97 + random.randrange(26)) * 2]) for _ in range(k))
    passage = " ".join(make("en", 1) + str(i) for i in range(120))
    exam = " ".join(f"question{i} {make('en', 1)}" for i in range(20))
    rows = [(i, make("en" if i % 2 else "de", 60 + i), "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "12 34 !!", "en")]
    rows += [(60 + i, make("en", 30) + " " + passage + " " + make("en", 50), "en") for i in range(3)]
    rows += [(70, rows[4][1], "de"), (4, rows[4][1], "de"), (71, rows[5][1] + " end", "en"), (None, rows[6][1], "de")]
    rows += [(80, make("en", 5) + " " + exam, "en"), (81, make("en", 900) + " " + exam, "en"), (82, "ü" * 300 + passage[:450], "de")]
    return [(i, t, lang, f"s{n % 3}", len(t or "")) for n, (i, t, lang) in enumerate(rows)], [(1, exam), (2, None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The frames after each stage, written and read as the pipeline does."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, items = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))
    return [sorted(map(tuple, f.collect()), key=str) for f in found], items


def test_columns(spark, stages):
    rows, _ = corpus()
    frame = spark.createDataFrame(rows[:5], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, frame, "").schema.simpleString() == frame.schema.simpleString()


def test_further_columns_and_empty_tables(spark, tmp_path):
    """Columns named as the operators' own come through every stage unchanged; an empty table stays empty."""
    rows, items = corpus()
    names = ["doc", "row", "id", "bits", "spans", "kept", "place", "score", "n_removed", "k1", "lang_pred", "_row", "component"]
    shape = COLUMNS + ", " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, *names) for r in rows if r[0] not in (81, 82)], shape)
    docs.write.parquet(f"{tmp_path}/docs")
    for frame in (spark.read.parquet(f"{tmp_path}/docs"), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns, name
            got = out.collect()
            assert (len(got) > 30) == (frame.count() > 0)
            assert all(tuple(r[len(rows[0]) :]) == tuple(names) for r in got)
        assert corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == frame.count()


def test_language(stages):
    rows, _ = corpus()
    assert stages[0][0] == sorted((r for r in rows if r[0] not in (50, 51, 52)), key=str)


def test_near_duplicates(stages):
    before, after = stages[0][:2]
    prints = [plain_fingerprint(r[1]) for r in before]
    close = [(a, b) for a in range(len(before)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    groups = {}
    for at, root in classes(range(len(before)), close).items():
        groups.setdefault(root, []).append(before[at])
    chosen = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    assert sorted(r[:3] for r in after if r[0] is not None) == sorted(r[:3] for r in chosen if r[0] is not None)  # row 4 is there twice
    assert len(after) < len(before)


def test_repeated_passages(stages):
    before, after = stages[0][1:3]
    expected = dict(zip((r[0] for r in before), passages([r[1] for r in before], 400)))
    assert [r[0] for r in after] == [r[0] for r in before]
    for (i, text, *_, n_chars), old in zip(after, before):
        assert len(old[1].encode()) - len(text.encode()) >= expected[i][1] and n_chars == len(text)
        assert (text == old[1]) == (expected[i][1] == 0)
    assert sum(a[1] != b[1] for a, b in zip(after, before)) >= 4


def test_passages_of_over_fifty_words(spark):
    """They have fewer than 400 bytes and are removed wherever they are; of 49 words nothing is."""
    random.seed(5)
    make = lambda k: " ".join(random.choice(["on", "that", "these", "seven"]) + str(random.randrange(1000)) for _ in range(k))
    passage, short = " ".join(f"w{i % 7}{i}" for i in range(53)), " ".join(f"v{i}" for i in range(49))
    assert len(passage) < 400
    own = [make(40), make(30), make(60), make(20)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{own[2]}\n{passage}"), (3, f"{own[3]} {short}"), (4, f"{short} {own[1][:90]}"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    left = {1: f"{own[0]}  {own[1]}", 2: f"{own[2]}\n", 3: rows[2][1], 4: rows[3][1], 5: ""}
    assert got == {i: (t, len(t)) for i, t in left.items()}


def test_decontaminated(stages):
    before, after = stages[0][2:4]
    assert after == [r for r in before if not contamination(r[1], stages[1])[4]]
    assert {80} == {r[0] for r in before} - {r[0] for r in after}


def test_tokens(stages):
    import hashlib

    before, after = stages[0][3:5]
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                               mergeable_ranks=bpe.parse_ranks(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = [(r[0], len(ids := theirs.encode_ordinary(r[1])), sha(" ".join(map(str, ids))), sha(r[1])) for r in before]
    assert after == sorted(expected, key=str)
