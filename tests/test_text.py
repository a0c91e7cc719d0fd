import pytest
from pyspark.sql import functions as F

from frames import one_col
from offerlake.functions import text as tx


def run(spark, expr, values, dtype="string"):
    return [r[0] for r in one_col(spark, values, dtype).select(expr(F.col("x"))).collect()]


@pytest.mark.parametrize("raw, expected", [
    ("<li class='x'>Soudeur<br/> TIG</li>", "Soudeur TIG"),
    ("Salaire &euro; 2100 &#8211; 2400", "Salaire 2100 2400"),
    (None, ""),
    ("poste\r\n\r\n a   pourvoir\tvite", "poste a pourvoir vite"),
    ("<td>1</td><td>2</td>", "12"),
    ("5 < 6 and 7 > 2", "5 2"),
    ("a &nbsp b", "a &nbsp b"),
    ("&#1234567; x", "&#1234567; x"),
    ("<a\nb> c", "<a b> c"),
    ("  padded  ", "padded"),
])
def test_html_clean_cases(spark, raw, expected):
    assert run(spark, tx.html_clean, [raw]) == [expected]


def test_html_clean_properties_on_pages(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    rows = pages.select("html", tx.html_clean("html").alias("c")).collect()
    assert rows
    for r in rows:
        assert r.c == r.c.strip() and "  " not in r.c and not any(ch in r.c for ch in "\n\r\t")
        left = iter(r.html)  # nothing is added or moved: the result is a subsequence, white space aside
        assert all(ch == " " or ch in left for ch in r.c)


def test_nested_text_from_json_keeps_what_is_no_json(spark):
    got = run(spark, lambda c: tx.nested_text_from_json(c, "libelle"),
              ["[CDI] Paris", '["a","b"]', '[{"libelle":"x"},"y"]', "{broken", '{"libelle":"z"}', '[{"libelle":"p"},{"libelle":"q"}]', "plain", None])
    assert got == ["[CDI] Paris", "a b", "x y", "{broken", "z", "p q", "plain", ""]


def test_display_date_offsets_and_minutes(spark):
    got = run(spark, tx.display_date, ["2025-06-01T10:20:30+02:00", "2025-06-01T10:20", "2025-06-01T10:20:30.123Z", "2025-06-01", "no"])
    assert got == ["2025-06-01", "2025-06-01", "2025-06-01", "2025-06-01", "N/A"]


def test_no_python_udf_in_text_rules(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    plan = pages.select(tx.html_clean("html"), tx.fts_clean("html"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_nested_text_typed(spark):
    df = spark.createDataFrame(
        [([{"libelle": "Braser"}, {"libelle": "Lire un plan"}],), (None,), ([{"libelle": ""}, {"libelle": None}, {"libelle": "Meuler"}],), ([],)],
        "c array<struct<libelle:string>>")
    assert [r[0] for r in df.select(tx.nested_text("c", "libelle")).collect()] == ["Braser Lire un plan", "", "Meuler", ""]


def test_nested_text_tolerant(spark):
    names = ['[{"libelle": "Tri"}, {"libelle": ""}, {"libelle": "Tournage"}]', '{"code": "7", "libelle": "Interim"}', "libre", None]
    assert run(spark, lambda c: tx.nested_text_from_json(c, "libelle"), names) == ["Tri Tournage", "Interim", "libre", ""]
    fields = ['[{"domaineLibelle": "Bois"}, {"libelle": "Metal"}]', '{"libelle": "Metal"}']
    assert run(spark, lambda c: tx.nested_text_from_json(c, "domaineLibelle"), fields) == ["Bois", ""]


def test_nested_struct(spark):
    df = spark.createDataFrame([({"libelle": "Saison", "code": "S"},), (None,)], "c struct<libelle:string,code:string>")
    assert [r[0] for r in df.select(tx.nested_text_of_struct("c", "libelle")).collect()] == ["Saison", ""]


def test_vector_text_keeps_separators(spark):
    df = spark.createDataFrame([("Dev", "", "", "", ""), (None, "d", None, "f", "")], "a string, b string, c string, d string, e string")
    got = [r[0] for r in df.select(tx.vector_text("a", "b", "c", "d", "e")).collect()]
    assert got == ["Dev    ", " d  f "]


@pytest.mark.parametrize("cv, expected", [
    ("Soudeur TIG pour la chaudronnerie et le levage", "soudeur tig chaudronnerie levage"),
    ("q r Cariste CACES 3 w", "cariste caces"),
    ("Paie|Compta*(Sage)", "paie compta sage"),
    ("\u2003Été\xa0: vendanges", "vendanges"),
    ("", ""),
    ("dans les et pour nous", ""),
    (None, ""),
])
def test_fts_clean_cases(spark, cv, expected):
    assert run(spark, tx.fts_clean, [cv]) == [expected]


def test_fts_clean_letter_spaced(spark):
    assert run(spark, tx.fts_clean, ["S o u d u r e  A r c"]) == ["soudure arc"]


def test_fts_clean_keeps_symbols(spark):
    assert run(spark, tx.fts_clean, ["C++ et C# data-engineer"]) == ["c++ c# data-engineer"]


def test_stopword_lookup_is_a_hash_set(spark):
    plan = one_col(spark, ["x"]).select(tx.fts_terms("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan.upper()


@pytest.mark.parametrize("h, expected", [
    ("un <b>Soudeur</b>, du <b>levage</b> / <b>TIG!</b>", ["soudeur", "levage", "tig"]),
    ("rien", []),
    (None, []),
    ("<b>et</b> <b>un</b> <b>Chef d'atelier</b>", ["chef datelier"]),
    ("<b>Bois</b><b> bois</b><b>BOIS.</b>", ["bois"]),
])
def test_headline_keywords(spark, h, expected):
    assert run(spark, tx.headline_keywords, [h]) == [expected]


def test_headline_keywords_first_ten(spark):
    h = " ".join(f"<b>word{i:02d}</b>" for i in range(15))
    assert run(spark, tx.headline_keywords, [h])[0] == [f"word{i:02d}" for i in range(10)]


@pytest.mark.parametrize("v, a, b, c, d, expected", [
    (3.0, 2.0, 4.0, -10.0, 10.0, 0.0),
    (7.0, 7.0, 7.0, 4.0, 9.0, 4.0),
    (1.0, 0.0, 4.0, 8.0, 0.0, 6.0),
])
def test_linear_map(spark, v, a, b, c, d, expected):
    got = one_col(spark, [v], "double").select(tx.linear_map(F.col("x"), a, b, c, d)).first()[0]
    assert got == pytest.approx(expected)


def test_display_date_and_percent(spark):
    got = run(spark, tx.display_date, ["2025-06-01T00:00:00Z", "2025-06-01T10:20:30.123Z", "garbage", None])
    assert got == ["2025-06-01", "2025-06-01", "N/A", "N/A"]
    assert run(spark, tx.percent, [0.29, 1.0, 0.0], "double") == [28, 100, 0]
