from pyspark.sql import functions as F

from corvane.llm.language_id import language_id


def test_each_declared_language_is_known(spark):
    say = {"en": "the house and the garden with the old tree was there", "de": "das haus und der garten mit dem alten baum war dort"}
    rows = [(k, f"{say[x]} {k % 7} {say[x]}" if k % 3 else f"hot {say[x]}", x) for k, x in enumerate(["en", "de"] * 1500)]
    rows += [(5000 + k, "το σπίτι και ο κήπος με το παλιό δέντρο " + "ήταν εκεί " * k, "el") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(df, declared=F.col("lang"), sample_rows=20).where("doc_id >= 5000 or doc_id < 9").collect()}
    assert all(got[5000 + k].language == "el" and not got[5000 + k].rejected for k in range(4))
    assert all(got[k].language == rows[k][2] for k in range(9))
