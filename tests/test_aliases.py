"""The alias query on names of more words than its SQL handles, against the product of each word's forms."""

from itertools import product

from tidemark import catalogue

SF = "/root/testdata/sf0.01"
FORMS = {"red": ["red", "reds"], "cats": ["cats", "cat"], "boxes": ["boxes", "box"], "glass": ["glass"], "of": ["of"]}


def test_names_of_any_number_of_words(spark, tmp_path):
    names = ["red cats", "red boxes of cats", "glass cats red", "of"]
    schema = spark.read.parquet(f"{SF}/part.parquet").schema
    rows = [tuple(n if f.name == "p_name" else None for f in schema.fields) for n in names]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.name, r.alias) for r in catalogue.queries()["aliases"](spark, str(tmp_path)).collect()}
    assert got == {(n, "".join(p)) for n in names for p in product(*[FORMS[w] for w in n.split()])}
