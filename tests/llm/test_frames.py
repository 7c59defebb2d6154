"""Every operator: nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from tillflow.llm import ann, bpe, contexttree, decontaminate, frames, pages, simhash, tokencounts, tokenfiles, toxicity, urlrules

DOCS = "doc_id long, text string, score double, digest string, bits long, n_tokens long, mark long, row long"
ROWS = [(1, "The cat sat on the mat. The cat sat."), (2, None), (3, ""), (None, "no id at all"), (4, " \n\t "),
        (5, "word " * 30_000), (1, "The cat sat on the mat. The cat sat."), (6, "x" * 50_000), (7, "é😀 ß\x1c\x85 end"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    frames.settings(spark)
    return spark.createDataFrame([(i, t, 0.5, "d", 3, 4, 5, 6) for i, t in ROWS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (5, 1, 0), (6, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def ids(df, col="doc_id"):
    return sorted((r[col] for r in df.select(col).collect()), key=repr)


def test_one_row_each(odd, labels, spark, tmp_path):
    want = sorted((i for i, _ in ROWS), key=repr)
    benchmark = spark.createDataFrame([(1, "the cat sat"), (2, None), (None, "mat"), (3, "")], "item_id long, text string")
    made = {
        "simhash": simhash.near_duplicates(odd), "bpe": bpe.encode_documents(odd), "counts": tokencounts.token_counts(odd),
        "toxicity": toxicity.toxicity(odd, labels), "contexts": contexttree.score(odd),
        "benchmark": decontaminate.contamination(odd, benchmark)}
    for name, df in made.items():
        assert ids(df) == want, name
    coder = tokenfiles.write_token_files(odd, f"{tmp_path}/tokens")
    assert ids(tokenfiles.read_token_files(spark, f"{tmp_path}/tokens", coder), "id") == want
    html = odd.withColumnRenamed("doc_id", "page_id").withColumn("html", F.concat(F.lit("<p>"), "text")).withColumn("url", F.lit(None).cast("string"))
    found = pages.main_texts(html)
    assert ids(found, "page_id") == want
    assert {r.n_chars for r in found.where("page_id in (2, 3)").collect()} == {0}
    judged = urlrules.judge(html)
    assert ids(judged, "page_id") == want
    assert {tuple(r)[1:] for r in judged.collect()} == {("", "", None, "allow")}


def test_one_row_of_each_group_where_ids_repeat(spark):
    frames.settings(spark)
    long = "some words that stand here in a row " * 3
    rows = [(1, long), (1, "something else"), (0, "something else"), (2, long), (None, "only without id"),
            (None, "only without id"), (None, long), (3, "three"), (3, "three")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    got = sorted((tuple(r) for r in simhash.drop_near_duplicates(docs).collect()), key=lambda r: r[2])
    assert got == [(1, long, 0), (0, "something else", 2), (None, "only without id", 4), (3, "three", 7)]


def test_empty_tables(spark, odd, labels, tmp_path):
    none = odd.limit(0)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
    assert bpe.encode_documents(none).count() == 0
    assert tokencounts.token_counts(none).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert contexttree.score(none).count() == 0
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(odd, benchmark).where("contaminated").count() == 0
    coder = tokenfiles.write_token_files(none, f"{tmp_path}/none")
    assert tokenfiles.read_token_files(spark, f"{tmp_path}/none", coder).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, F.col("vec_id") % 20 == 0, 5).count() == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.main_texts(empty).count() == 0
    assert urlrules.judge(empty).count() == 0


def test_clean_rows_stay_whatever_their_id(spark):
    frames.settings(spark)
    benchmark = spark.createDataFrame([(1, "a passage of the benchmark")], "item_id long, text string")
    leak = "here is A passage of the benchmark, copied"
    rows = [(1, leak), (1, "clean"), (None, leak), (None, "also clean"), (None, None), (2, "clean"), (3, leak)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in decontaminate.drop_contaminated(docs, benchmark).collect()]
    assert sorted(kept, key=repr) == sorted([r for r in rows if r[1] != leak], key=repr)


def test_filters_keep_all_columns(odd, labels, spark):
    benchmark = spark.createDataFrame([(1, "no id at all")], "item_id long, text string")
    civil = toxicity.drop_toxic(odd, labels)
    single = simhash.drop_near_duplicates(odd)
    unseen = decontaminate.drop_contaminated(odd, benchmark)
    for df in (civil, single, unseen):
        assert df.columns == odd.columns
    # equal texts leave one row; null, empty and blank texts are one group
    assert ids(single) == sorted([1, 2, 5, 6, 7, None], key=repr)
    assert unseen.where("text = 'no id at all'").count() == 0
    assert ids(unseen) == [1, 1, 2, 3, 4, 5, 6, 7, None]  # the other row without id stays


def test_filters_with_clashing_names_and_a_map(spark, labels):
    frames.settings(spark)
    names = "_bad bad _several several _head head _bits bits _id _own _root root _row row own asked id digest".split()
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "no id at all"), (None, "e f g"), (2, "e f g h i j")]
    docs = spark.createDataFrame([(i, t, {"k": n}, *["x"] * len(names)) for n, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, tags map<string,int>, " + ", ".join(f"{n} string" for n in names))
    benchmark = spark.createDataFrame([(1, "no id at all")], "item_id long, text string")
    single = simhash.drop_near_duplicates(docs)
    assert single.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.tags["k"]) for r in single.collect()), key=repr) == [
        (1, "a b c d", 0), (2, "e f g h i j", 5), (2, "no id at all", 3), (None, "e f g", 4)]
    unseen = decontaminate.drop_contaminated(docs, benchmark)
    assert unseen.columns == docs.columns and unseen.count() == 5
    civil = toxicity.drop_toxic(docs, labels)
    assert civil.columns == docs.columns and civil.count() == 6
