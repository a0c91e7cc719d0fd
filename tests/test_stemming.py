import pytest

from offerlake.functions.stemming import french_stem, stem_vocabulary

# published example words and their stems
EXAMPLES = {
    "continu": "continu continua continuait continuant continuation continue continué continuer continuera continuez continuité",
    "continuel": "continuel continuelle continuellement continuelles continuels",
    "contourn": "contournait contournant contourne",
    "contract": "contractait contracté contractée contracter contractés contractions",
    "mainten": "maintenaient maintenait maintenant maintenir",
    "majestu": "majestueuse majestueusement majestueux",
    "major": "major majorité majorités", "malad": "malade malades maladie maladies maladive",
    "maîtr": "maître maîtres", "contrari": "contraria", "continuon": "continuons", "contors": "contorsions",
}


@pytest.mark.parametrize("stem", EXAMPLES)
def test_published_examples(stem):
    assert {french_stem(w) for w in EXAMPLES[stem].split()} == {stem}


def test_plural_meets_singular_and_other_text_stays():
    assert french_stem("développeurs") == french_stem("développeur")
    assert [french_stem(w) for w in ("", "c++", "123", "x")] == ["", "c++", "123", "x"]


def test_vocabulary_holds_each_word_once(spark):
    words = spark.createDataFrame([("mains",), ("mains",), (None,), ("main",)], "lexeme string")
    assert sorted(tuple(r) for r in stem_vocabulary(words).collect()) == [("main", "main"), ("mains", "main")]
