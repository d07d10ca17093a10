import pytest
from pyspark.sql import functions as F

from sparkgauge.functions.names import clean, normalized, tokens
from sparkgauge.operators import mapping as M
from sparkgauge.operators import profile as P
from sparkgauge.operators import refine as R
from sparkgauge.operators import schemas as S
from sparkgauge.operators.semantic import semantic_types, value_hints

F4 = {
    "is_active": (["true", "false", "true", "false", "true"], "boolean"), "verified": (["1", "0", "1", "0", "1"], "boolean"), "age": (["25", "30", "35", "40", "45"], "bigint"),
    "price": (["19.99", "29.99", "5", "4.5", "1e3"], "double"), "birth_date": (["1990-05-15", "1985-01-01", "2000-12-31", "1999-09-09", "1970-01-01"], "date"),
    "created_at": (["2023-01-15 10:30:00"] * 4 + ["2023-01-16 11:00:00"], "timestamp_ntz"), "email": (["john@example.com", "a@b.org", "c@d.net", "e@f.io", "g@h.de"], "string"),
    "phone": (["+1-555-123-4567"] * 3 + ["+1-555-987-6543"] * 2, "string"), "website": (["https://example.com"] * 5, "string"),
    "user_id": (["550e8400-e29b-41d4-a716-446655440000"] * 5, "string"), "category": (["A", "B", "", None, "C"], "string"), "nothing": (["", None, "", None, ""], "string"),
}


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame(list(zip(*[v for v, _ in F4.values()], strict=True)), ", ".join(f"{n} string" for n in F4))


def test_inferred_types(strings):
    assert R.inferred(strings) == {n: t for n, (_, t) in F4.items()}


def test_refined_values(strings):
    row = R.refined(strings).first()
    assert row.is_active is True and row.verified is True and row.age == 25 and row.price == 19.99 and str(row.birth_date) == "1990-05-15"


def test_refinement_guards(spark):
    df = spark.createDataFrame([(" 12 ", "1.5", "2023-05", "t"), ("13", "2f", "2023-06", "f")], "a string, b string, c string, d string")
    assert set(R.inferred(df).values()) == {"string"}


def test_three_boolean_words_are_no_boolean(spark):
    df = spark.createDataFrame([("1",), ("0",), ("yes",)], "a string")
    assert R.inferred(df) == {"a": "string"}


def test_enforce(spark):
    df = spark.createDataFrame([("$2.5", "19.99", "2024-01-01", "nan"), ("x", "1,299", "nope", "ok")], "i string, f string, d string, s string")
    a, b = R.enforce(df, {"i": "int", "f": "float", "d": "datetime", "s": "string"}).collect()
    assert (a.i, a.f, a.s, b.i, b.f, b.d, b.s) == (2, 19.99, None, None, None, None, "ok")
    assert R.schema_word("interval day") == "string" and R.schema_word("bigint") == "int"


def test_semantic_types(strings):
    found = {r.column: r.semantic_type for r in semantic_types(strings).collect()}
    assert found["email"] == "Email" and found["website"] == "URL" and found["user_id"] == "UUID" and found["phone"] == "Phone"
    assert found["birth_date"] == "Date" and found["created_at"] == "DateTime" and found["age"] == "Price"
    assert "category" not in found


def test_hints(spark):
    df = spark.createDataFrame([("a@b.co", 1), ("c@d.co", 2), ("x", 3)], "e string, n int")
    got = {(r.column, r.hint): (round(r.share, 3), r.boost) for r in value_hints(df).collect() if r.share}
    assert got == {("e", "Email"): (0.667, 0.03), ("n", "numeric"): (1.0, 0.0)}


def test_names(spark):
    names = ["Email", "PhoneNumber", "ReviewText", "PHONE", "UUID", "IP Address", "e-mail", "user_id"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(normalized(F.col("n")).alias("x"), clean(F.col("n")).alias("c"), tokens(F.col("n")).alias("t"))
    assert [r.x for r in df.collect()] == ["email", "phone_number", "review_text", "p_h_o_n_e", "u_u_i_d", "i_p_address", "e_mail", "user_id"]
    assert df.collect()[-1].t == ["user"]


def decided(**kw):
    return {r.source: (r.status, r.target) for r in M.map_columns(**kw).collect()}


def test_mapping(spark):
    people = spark.createDataFrame([("a@example.com", "123", "Alice"), ("b@example.com", "456", "Bob")], "Email string, PHONE string, Name string")
    assert {k: v[1] for k, v in decided(df=people, references=["email", "phone", "name"], threshold=0.7).items()} == {"Email": "email", "PHONE": "phone", "Name": "name"}
    got = decided(columns=["Email", "PhoneNumber", "Name"], references=["email", "name"], threshold=0.7, spark=spark)
    assert got["Email"][1] == "email" and got["Name"][1] == "name" and got["PhoneNumber"][0] != "mapped"
    assert {v[0] for v in decided(df=spark.range(1).selectExpr("id as foo", "id as bar"), references=["email", "phone", "name"]).values()} == {"unmapped"}
    assert decided(columns=["Email"], references=["EMAIL", "email"], spark=spark)["Email"][0] == "mapped"
    got = decided(columns=["e_mail", "cust_phone"], references=["email", "phone"], synonyms={"email": ["e_mail"], "phone": ["cust_phone"]}, threshold=0.7, spark=spark)
    assert {k: v[1] for k, v in got.items()} == {"e_mail": "email", "cust_phone": "phone"}
    got = decided(columns=["Label", "Title", "ReviewText"], references=["label", "title", "text"], threshold=0.5, spark=spark)
    assert {k: v[1] for k, v in got.items()} == {"Label": "label", "Title": "title", "ReviewText": "text"}
    assert decided(columns=["email"], references=["email", "e_mail"], epsilon=1.0, threshold=0.5, spark=spark)["email"][0] in ("ambiguous", "mapped")
    assert decided(columns=["phone_number"], references=["phone"], threshold=0.99, spark=spark)["phone_number"][0] == "unmapped"
    assert decided(columns=["a"], references=[], spark=spark) == {"a": ("unmapped", None)}
    with pytest.raises(ValueError):
        M.map_columns(references=["a"], spark=spark)


def test_synonyms_stay_as_they_are():
    M.merged_synonyms({"email": ["zz"], "new": ["a"]})
    assert "zz" not in M.SYNONYMS["email"] and "new" not in M.SYNONYMS


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("p_h_o_n_e", "phone")], "a string, b string")
    assert df.select(M.sequence_ratio("a", "b")).first()[0] == pytest.approx(10 / 14)


def test_dynamic_references():
    tables = {"a": ["x", "y"], "b": ["y", "z"], "c": ["w"]}
    assert M.dynamic_references(tables, "a", ["u"]) == ["u", "w", "z"]


def test_diff(spark):
    old, new = {"id": "bigint", "name": "string", "age": "bigint"}, {"id": "bigint", "name": "utf8", "age": "bigint", "email": "string"}
    assert S.diff_of(old, new) == {"added": {"email": "string"}, "removed": {}, "changed": {"name": {"old": "string", "new": "utf8"}}}
    frames = [spark.createDataFrame(list(x.items()), "column string, type string") for x in (old, new)]
    assert {(r.column, r.change) for r in S.diff(*frames).collect()} == {("email", "added"), ("name", "changed")}
    assert "email: string" in S.diff_text(S.diff_of(old, new)) and S.diff_text(S.diff_of(old, old)).startswith("Keine")


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a", None, [1]), (2, "", 2.0, [2]), (3, None, 4.0, [3]), (4, "a", 0.0, [4])], "i int, s string, d double, l array<int>")
    assert {r.column: r.missing_ratio for r in P.missing_ratios(df).collect()} == {"i": 0.0, "s": 0.5, "d": 0.25, "l": 0.0}
    stats = {r.column: r for r in P.numeric_stats(df).collect()}
    assert (stats["d"].mean, stats["d"].std, stats["d"].zeros) == (2.0, 2.0, 1)
    top = P.text_stats(df, ["i"]).orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in top] == [("a", 2), ("None", 1), ("", 1)] and top[0].unique_count == 3
    assert P.nested_columns(df) == ["l"]
    assert P.categorical_columns(df).count() == 0
    assert {r.missing_ratio for r in P.missing_ratios(df.where("i > 9")).collect()} == {0.0}
    assert P.numeric_stats(df.where("i > 9")).count() == 0


def test_enforce_takes_numbers_as_they_are(spark):
    from sparkgauge.operators.refine import enforce

    df = spark.sql("SELECT 12345678.0D AS a, 1.5e-7D AS b, '1,234.5 EUR' AS c, 2.5D AS d")
    row = enforce(df, {"a": "int", "b": "float", "c": "int", "d": "int"}).first()
    assert (row.a, row.b, row.c, row.d) == (12345678, 1.5e-7, 1234, 2)


def test_semantic_scores_of_an_empty_truth(spark):
    from sparkgauge.operators.evaluate import semantic_scores

    none = spark.createDataFrame([], "column string, semantic_type string")
    some = spark.createDataFrame([("a", "URL")], "column string, semantic_type string")
    assert tuple(semantic_scores(some, none).first())[3:] == (0.0, 1.0, 0.0)
    assert tuple(semantic_scores(none, none).first())[3:] == (1.0, 1.0, 1.0)
