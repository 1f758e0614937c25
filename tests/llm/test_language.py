from pyspark.sql import functions as F

from itinera.llm import language_id

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, confidence string"


def test_given_documents_and_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = language_id.identify_pages(pages, docs).collect()
    assert len(out) == pages.count()
    assert sum(r.lang == r.declared for r in out) >= 0.97 * len(out)


def test_held_out_accuracy_of_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, model = language_id.train(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1")
    out = language_id.identify(rest, languages, model, "text", "doc_id", F.lit(None).cast("string"), None)
    right = out.join(rest.select(F.col("doc_id").alias("id"), F.col("lang").alias("given")), "id").filter("text_lang = given").count()
    assert right >= 0.97 * rest.count()


def test_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("confidence", F.lit("clash"))
    odd = spark.createDataFrame([(None, "Ist der und das nicht auf", "de", None, 1, ""), (900001, None, "en", "src1", 0, ""), (900002, "", None, None, 0, ""),
                                 (900003, "123 !!! 456", "en", "src1", 9, ""), (900004, "the and of to in that", None, "src1", 9, ""),
                                 (900004, "the and of to in that", None, "src1", 9, "")], DOCS)
    kept = language_id.keep_identified(base.unionByName(odd))
    ids = [r.doc_id for r in kept.filter("doc_id is null or doc_id > 900000").collect()]
    assert sorted(ids, key=str) == [900004, 900004, None]
    assert {r.lang for r in kept.filter("doc_id = 900004").collect()} == {"en"}
    assert language_id.keep_identified(base.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.b.fr/x", "<html lang='fr'><p>le la les des une est dans pour</p>"), (None, "::", "")],
                                  "page_id bigint, url string, html string")
    out = {r.page_id: r for r in language_id.identify_pages(pages, base).collect()}
    assert out[2].lang == "fr" and out[2].host == "a.b.fr" and not out[1].accepted and out[None].lang == "und"


def test_priors_decide_what_the_text_leaves_open(spark):
    rows = [(i, "le la des une est pour dans avec que les", "fr", "h1", 1, "") for i in range(30)]
    rows += [(100 + i, "the and of to in that is was for with", "en", "h2", 1, "") for i in range(30)]
    rows += [(500, "xq", None, "h1", 1, ""), (501, "xq", None, "h2", 1, "")]
    docs = spark.createDataFrame(rows, DOCS)
    languages, model = language_id.train(docs)
    out = {r.id: r.lang for r in language_id.identify(docs, languages, model, "text", "doc_id", F.col("source"), F.col("lang")).collect()}
    assert out[500] == "fr" and out[501] == "en"
