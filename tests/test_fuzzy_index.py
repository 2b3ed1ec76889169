"""Double Metaphone and the stored index of words and values."""

import random

import pytest
from pyspark.sql import functions as F

from lathework.functions.phonetics import double_metaphone
from lathework.operators import filters, fuzzy_index

#: Published codes of well-known names and words.
CODES = {
    "maurice": ("MRS", "MRS"), "aubrey": ("APR", "APR"), "cambrillo": ("KMPRL", "KMPR"), "heidi": ("HT", "HT"), "katherine": ("K0RN", "KTRN"), "thumb": ("0M", "TM"),
    "schmidt": ("XMT", "SMT"), "laura": ("LR", "LR"), "ghislane": ("JLN", "JLN"), "caesar": ("SSR", "SSR"), "chemical": ("KMKL", "KMKL"), "architect": ("ARKTKT", "ARKTKT"),
    "czerny": ("SRN", "XRN"), "focaccia": ("FKX", "FKX"), "bacchus": ("PKS", "PKS"), "accident": ("AKSTNT", "AKSTNT"), "edge": ("AJ", "AJ"), "edgar": ("ATKR", "ATKR"),
    "hugh": ("H", "H"), "laugh": ("LF", "LF"), "jose": ("HS", "HS"), "cabrillo": ("KPRL", "KPR"), "campbell": ("KMPL", "KMPL"), "sugar": ("XKR", "SKR"), "island": ("ALNT", "ALNT"),
    "snider": ("SNTR", "XNTR"), "school": ("SKL", "SKL"), "schermerhorn": ("XRMRRN", "SKRMRRN"), "thomas": ("TMS", "TMS"), "arnow": ("ARN", "ARNF"), "filipowicz": ("FLPTS", "FLPFX"),
    "breaux": ("PR", "PR"), "zhao": ("J", "J"), "smith": ("SM0", "XMT"), "schneider": ("XNTR", "SNTR"), "jankelowicz": ("JNKLTS", "ANKLFX"), "tagliaro": ("TKLR", "TLR"),
    "cagney": ("KKN", "KKN"), "wasserman": ("ASRMN", "FSRMN"), "vasserman": ("FSRMN", "FSRMN"), "michael": ("MKL", "MXL"), "richard": ("RXRT", "RKRT"), "johnson": ("JNSN", "ANSN"),
    "jonson": ("JNSN", "ANSN"), "smyth": ("SM0", "XMT"), "success": ("SKSS", "SKSS"), "bellocchio": ("PLX", "PLX"), "resnais": ("RSN", "RSNS"), "rogier": ("RJ", "RJR"),
}


@pytest.mark.parametrize("word", CODES)
def test_double_metaphone_of_known_words(word):
    assert double_metaphone(word) == CODES[word]


def test_double_metaphone_takes_any_text():
    assert double_metaphone("") == ("", "") and double_metaphone("123 é") == ("", "") and double_metaphone("x" * 5000)[0].startswith("S")
    rng = random.Random(1)
    for _ in range(3000):
        a, b = double_metaphone("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12))))
        assert set(a + b) <= set("ABFHJKLMNPRSTX0")


def names(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, name string")


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_by_sound_and_by_spelling_when_nothing_sounds_alike(spark, tmp_path):
    df = names(spark, ["John Johnson", "Jane Jonson", "Anne Smyth", "Peter Smith", "Bob Brown", None, " "])
    index = fuzzy_index.build(df, "name", str(tmp_path / "a"))
    for search in (lambda q: fuzzy_index.phonetic(df, "name", index, q), lambda q: filters.search(df, "name", q)):
        assert ids(search("smyth")) == [2, 3] and ids(search("jonson")) == [0, 1]
        assert 0 in ids(search("Jhonson"))  # no such code: by spelling
    assert ids(fuzzy_index.phonetic(df, "name", index, "smitt bob")) == [] and ids(fuzzy_index.phonetic(df, "name", index, "")) == list(range(7))
    # Either code of either word may match: both are XMT.
    assert ids(filters.phonetic(names(spark, ["Schmidt", "Smith"]), "name", "smith")) == [0, 1]


def test_the_stored_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    df = names(spark, [" ".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(600)] + [None, "", "  ", "O'Brien-Smith", "Été ÉTÉ"])
    fuzzy_index.build(df, "name", str(tmp_path / "b"))
    index = fuzzy_index.FuzzyIndex(spark, str(tmp_path / "b"))  # opened again
    for q in [*rng.sample(stems, 2), "a", "ag cde", "zzz", "obrien", ""]:
        for level in ("loose",):
            assert ids(fuzzy_index.fuzzy(df, "name", index, q, level)) == ids(filters.fuzzy(df, "name", q, level)), q
        assert ids(fuzzy_index.phonetic(df, "name", index, q, False)) == ids(filters.phonetic(df, "name", q)), q
    for q in ["ab", "gfe dcb", "obrien"]:
        assert fuzzy_index.suggestions(index, q).collect() == filters.suggestions(df, "name", q).collect(), q


def test_a_search_reads_only_the_folders_of_its_keys(spark, tmp_path):
    rng = random.Random(5)
    df = names(spark, ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(400)])
    index = fuzzy_index.build(df, "name", str(tmp_path / "c"))
    whole, found = index.table("keys"), index.lookup("keys", ["ab", "bc"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert found.rdd.getNumPartitions() <= 2 < len(whole.inputFiles()) / 4
    assert whole.select("part").distinct().count() > 40
    assert {r.key for r in found.collect()} <= {"ab", "bc"}


def test_index_of_an_empty_table(spark, tmp_path):
    df = names(spark, ["x"]).where("id < 0")
    index = fuzzy_index.FuzzyIndex(spark, fuzzy_index.build(df, "name", str(tmp_path / "d")).path)
    assert index.path and fuzzy_index.build(names(spark, [None]), "name", str(tmp_path / "e")).path
