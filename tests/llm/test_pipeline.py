import random
import re

import corpus_pipeline
from quillstone.llm.mixing import mix_sources
from quillstone.llm.ngram_join import ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=240):
    r = random.Random(6)
    words = {"en": "the of and to in that with for was".split(), "de": "der und die nicht mit auf ist von auch".split()}
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de"])
        text = " ".join(r.choice(words[lang]) + r.choice(["", "er", "ing", "ung", "s"]) for _ in range(r.randint(30, 120)))
        rows.append((i, text, lang, f"src{i % 5}", len(text)))
    rows += [(1000 + i, rows[i][1].replace(" ", "  ", 3), rows[i][2], "copy", 1) for i in range(20)]
    rows += [(2000 + i, rows[i][1] + " tail", rows[i][2], "near", 1) for i in range(20)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "x", 0), (3002, "12 34 !!", "en", "x", 0), (5, rows[5][1], "en", "src0", 1), (None, "the cat and the others of that in with for", "en", None, 3)]
    return rows


def test_stages_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    step = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixture", "packed"]
    kept = step["language"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id < 3000").collect()))
    got = step["exact"](spark, kept, "").collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    want = {}
    for x in kept.collect():
        if norm(x.text) not in want or (x.doc_id is not None and x.doc_id < want[norm(x.text)]):
            want[norm(x.text)] = x.doc_id
    assert sorted(map(str, [x.doc_id for x in got])) == sorted(map(str, want.values()))
    one = spark.createDataFrame(got, SCHEMA)
    comp = {x.doc_id: x.component_id for x in ngram_join(one, 5, 80, 100).collect()}
    near = step["near"](spark, one, "")
    assert sorted(map(str, (x.doc_id for x in near.collect()))) == sorted(str(d) for d, c in comp.items() if d == c)
    assert {c for d, c in comp.items() if d is not None and d >= 2000} == set(range(20))
    mixed = step["mixture"](spark, near, "")
    copies = sorted(str(x.doc_id) for x in mix_sources(near).collect() for _ in range(x.copies))
    assert mixed.columns == docs.columns and sorted(str(x.doc_id) for x in mixed.collect()) == copies
    pieces = step["packed"](spark, mixed, "").collect()
    assert sum(x.start == 0 for x in pieces) == len(copies)


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
        docs = spark.createDataFrame([], SCHEMA)


def test_clashing_columns_and_odd_rows(spark):
    names = ["__row", "__sha", "__hit", "__slot", "__word", "__n", "__id", "__stays", "__own", "__alike", "rid", "key", "label", "copies", "size"]
    rows = corpus(60) + [(4000, "the of and to in that " * 9000, "en", "src1", 9), (4000, "the of and to in that " * 9000, "en", "src1", 9)]
    docs = spark.createDataFrame([(*x, *range(len(names))) for x in rows], ", ".join([SCHEMA, *(f"`{c}` int" for c in names)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(tuple(x)[5:] == tuple(range(len(names))) for x in got), name
        if name == "exact":
            assert sum(x.doc_id == 4000 for x in got) == 1 and sum(x.doc_id == 5 for x in got) == 1
        if name == "near":
            assert {x.doc_id for x in got} >= {4000, 5, None}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("doc_id = 4000 and start = 0").count() == 2


def test_sweep_leaves_nothing(spark):
    import os

    from quillstone.llm.common import shared_dir, stash, sweep

    stash(spark.range(3), "some")
    folder = shared_dir(spark).removeprefix("file://") + "/quillstone"
    assert os.listdir(folder)
    sweep(spark)
    assert not os.listdir(folder)
