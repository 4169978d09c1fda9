"""Every stage of the corpus pipeline over odd rows: nulls, empty texts, ties, repeated rows, no rows, further columns."""

import random

import pytest

import corpus_pipeline
from tessera.llm.common import Scratch
from tests.conftest import SF
from tests.llm.test_texts import jaccard_brute

KIND = "doc_id long, text string, lang string, source string, n_chars long, copy_no int, shuffle_key string, node long, least long, n long"


def good(rnd, n=80):
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def odd_rows():
    rnd = random.Random(11)
    base = [good(rnd) for _ in range(6)]
    near = base[0].split()
    near[40] = "changed"
    texts = [*base, base[1], " ".join(near), None, "", "   ", "one", "\x00 � é", "word " * 200, base[2] + " a@b.com +1 (234) 555-6789", "9" * 3000]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if i % 7 == 0 else len(t or ""), i, None, -i, 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], (*rows[3][:2], "aa", *rows[3][3:]), (4, base[5] + " more", "en", "s1", 5, 1, "x", 1, 1, 1), (None, base[4], "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(odd_rows(), KIND).repartition(3)


def run(spark, number, docs):
    return Scratch(spark, "t").keep(corpus_pipeline.STAGES[number][1](spark, docs, SF), "stage")


@pytest.mark.parametrize("number", range(5))
def test_stages_of_nothing(spark, number):
    out = run(spark, number, spark.createDataFrame([], KIND))
    assert out.count() == 0 and (number == 4 or out.columns == [f.split()[0] for f in KIND.split(", ")])


def test_quality_drops_what_has_no_words_and_carries_the_rest(spark, docs):
    out = run(spark, 0, docs)
    assert out.columns == docs.columns
    kept = {tuple(r) for r in out.collect()}
    assert kept <= {tuple(r) for r in docs.collect()} and not any(r[1] is None or len(r[1].split()) < 50 for r in kept)


def test_near_duplicates_deal_texts_alike_at_every_size(spark, docs):
    plan = corpus_pipeline.near_duplicates(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"]), SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    out = run(spark, 1, docs)
    assert out.columns == docs.columns
    got = out.collect()
    component: dict[int, int] = {}
    for x in jaccard_brute([r[:2] for r in odd_rows() if r[0] is not None]):
        key, _, least = eval(x)
        component[key] = min(component.get(key, key), least)
    assert {r.doc_id for r in got} == {k for k, least in component.items() if k == least} | {None}
    assert sum(r.doc_id is None for r in got) == 2
    assert sorted((r.lang or "") for r in got if r.doc_id == 3) == [""] if odd_rows()[3][2] is None else ["aa"]  # the least of two rows with one key and text
    assert len({(r.doc_id, r.text) for r in got if r.doc_id == 4}) == sum(r.doc_id == 4 for r in got) == (2 if component[4] == 4 else 0)


def test_personal_data_is_masked_and_all_rows_stay(spark, docs):
    out = run(spark, 2, docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_key = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert "[email]" in by_key[14].text and "555-6789" not in by_key[14].text and by_key[14].n_chars == len(by_key[14].text)
    assert by_key[8].text is None and by_key[9].text == ""


def test_mixing_keeps_columns_of_clashing_names(spark, docs):
    out = run(spark, 3, docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    again = run(spark, 3, docs)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_packing_holds_every_row(spark, docs):
    out = run(spark, 4, docs).toPandas()
    assert len(out[out.start == 0]) == len(odd_rows()) and out.length.min() >= 1


def test_a_long_text_among_short_ones(spark):
    rnd = random.Random(3)
    text = " ".join(rnd.choice(("alpha", "beta", "gamma", "delta")) + str(rnd.randrange(10**6)) for _ in range(200_000))
    rows = [(1, text, "en", "a", len(text)), (2, text + " tail", "en", "a", len(text) + 5), (3, good(rnd), "en", "b", 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in run(spark, 1, docs).collect()} == {1, 3}
    assert run(spark, 2, docs).count() == 3 and run(spark, 0, docs).count() <= 3
    assert run(spark, 4, docs).groupBy().sum("length").first()[0] > 400_000
