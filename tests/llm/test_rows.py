"""Every operator on awkward rows: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from lodestead.llm import alignment, audit, decontaminate, embeddings, linededup, lm, mixing, pii, quality, secrets, simhash, tokens, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, t string, size int, batch int, fp int, _id int, node int"
LONG = "the quick brown fox jumps over a lazy dog and then rests. " * 4000


def _row(i, text, source="a"):
    return (i, text, "en", source, len(text) if text else 0, "x", "y", 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def docs(spark):
    same = "one two three four five six seven eight nine ten."
    rows = [_row(1, same), _row(1, same), _row(2, same, None), _row(None, None), _row(3, None, "b"), _row(4, ""), _row(5, " \t\n"), _row(6, LONG, "b"),
            _row(7, "mail ann@ex.org or +1 555 123 4567 now"), _row(None, "no id here at all."), _row(8, "x" * 300_000)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def _labels(spark, rows=((1, 1, 0), (2, 0, 1), (None, 1, 1), (6, 1, None))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def _operators(spark, vocabulary):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten"), (2, None), (None, ""), (3, "a b")], "item_id bigint, text string")
    return {
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, _labels(spark))),
        "tokens": lambda d: tokens.count_tokens(d, vocabulary),
        "quality": lambda d: quality.score(d, quality.fit(d)[1]),
        "lm": lm.score,
        "simhash": simhash.simhash_groups,
        "mixing": mixing.mix,
        "linededup": linededup.dedup_units,
        "pii": pii.find_pii,
        "alignment": lambda d: alignment.align_documents(d, vocabulary, vocabulary.replace("byte_bpe_50k.json", "piece_bpe_32k.model")),
        "audit": audit.filter_masks,
        "secrets": secrets.find_secrets,
        "decontaminate": lambda d: decontaminate.leaks(d, bench),
    }


@pytest.mark.parametrize("name", ["toxicity", "tokens", "quality", "lm", "simhash", "mixing", "linededup", "pii", "alignment", "secrets"])
def test_one_row_each(spark, docs, none, vocabulary, name):
    run = _operators(spark, vocabulary)[name]
    assert sorted(str(r[0]) for r in run(docs).select("doc_id").collect()) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    out = run(none)
    assert out.count() == 0 and out.columns == run(docs).columns


def test_masks_on_awkward_rows(spark, docs, none, vocabulary):
    run = _operators(spark, vocabulary)["audit"]
    rows = run(docs).collect()
    assert sum(r.n for r in rows) == docs.count() and {r.part for r in rows} == {"a", "b", ""}
    # of the rows with one text only those of the least id stay; 4 repeats the null text of 3, which has no id nowhere
    assert {r.doc_id for r in rows if r.mask & 16} == {2, 4}
    assert run(none).count() == 0


def test_leaks_on_awkward_rows(spark, docs, none, vocabulary):
    run = _operators(spark, vocabulary)["decontaminate"]
    assert {(r.doc_id, r.item_id) for r in run(docs).collect()} == {(1, 1), (2, 1)}
    assert run(none).count() == 0
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(docs, empty).count() == 0


@pytest.mark.parametrize("stage", [
    lambda spark, d: quality.keep_accepted(d, quality.fit(d)[1]), lambda spark, d: simhash.keep_one(d), lambda spark, d: pii.redact(d),
    lambda spark, d: linededup.remove_units(d),
    lambda spark, d: decontaminate.drop_leaking(d, spark.createDataFrame([(1, "two three four five six seven eight nine ten")], "item_id bigint, text string"))])
def test_stages_keep_columns(spark, docs, none, stage):
    out = stage(spark, docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert 0 < out.count() <= docs.count()
    assert stage(spark, none).count() == 0


def test_keep_one_keeps_one(spark, docs):
    kept = simhash.keep_one(docs).select("doc_id").collect()
    # 1 stands for 2, 3 for every text without words; the text without an id has no like
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (True, None)]
    twins = spark.createDataFrame([(1, "one two three four five"), (1, "six seven eight nine ten"), (1, "six seven eight nine ten")], "doc_id bigint, text string")
    assert sorted(r.text for r in simhash.keep_one(twins).collect()) == ["one two three four five", "six seven eight nine ten"]


def test_mix_keeps_clashing_columns(spark, docs):
    frame = docs.withColumn("taken", F.lit("t")).withColumn("Target", F.lit(2)).withColumn("source_size", F.lit(3))
    out = mixing.mix(frame, carry=frame.columns)
    assert out.columns == [*[f"{c}_before" if c.lower() in mixing.ADDED else c for c in frame.columns], *mixing.ADDED]
    assert out.count() == docs.count() and {r.taken_before for r in out.collect()} == {"t"}
    twins = spark.createDataFrame([(None, f"word number {i}", "a") for i in range(50)], "doc_id bigint, text string, source string")
    first, again = (sorted(map(tuple, mixing.mix(x, carry=["text"]).collect())) for x in (twins, twins.repartition(7)))
    assert first == again


def test_embeddings_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 0.3]), (10, [1.0, 0.4]), (11, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (12, [0.0, -1.0]), (13, [1e-200, 1e200])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1)).withColumn("cell", F.lit("x"))
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_groups(frame).collect()}
    # 9 is within the limit of 1 and 2, 10 only of 9; 13 points up with the row without an id
    assert {(1, 3, 1, True), (2, 3, 1, False), (9, 4, 1, False), (10, 1, 1, False), (13, 1, 13, True), (None, 1, 13, True), (11, 0, 11, True), (12, 0, 12, True)} <= got
    assert {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8)} <= got
    assert embeddings.near_groups(frame.limit(0)).count() == 0
