import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.normalize import NORMALIZED_COLUMNS, normalize_record, normalize_records

ODD = ["", " ", "Café & Co.", "ﬁn ½ x²", "ŒUVRE ĳ ŉ", "मॉडर्न Pvt Ltd", "a\u00a0b\u2028c", 'say "hi" \\ there', "St-Jean_1 12-B", "İstanbul ΣΑΣ", "한국 기업", "e\u0301te\u0301", "Straße", "١٢٣٤٥ road", "\x1c\x85x", "null none Nan st"]


def plain(x: str) -> str:
    x = "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s-]", " ", x.replace("&", " and "))).strip()


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_normalize_text_against_plain(spark):
    rng = random.Random(5)
    alphabet = "aZé ßœ½ﬁ&-_'\"\\²٣मॉ한\u0301\u00a0\t9"
    values = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(15))) for _ in range(300)]
    assert column(spark, values, T.normalize_text) == [plain(v) for v in values]
    assert column(spark, [None], T.normalize_text) == [""]


@pytest.mark.parametrize("name, core", [("acme private limited", "acme"), ("limited", "limited"), ("private limited", "private"), ("x co ltd inc", "x"), ("societe anonyme", "societe anonyme"), ("foods sa plc", "foods"), ("sas", "sas"), ("", "")])
def test_name_core(spark, name, core):
    assert column(spark, [name], T.name_core) == [core]


def test_name_core_equals_a_loop(spark):
    rng = random.Random(2)
    pool = ["acme", "sa", "co", "ltd", "private limited", "pvt ltd", "limited liability", "gmbh", "x", "societe anonyme", "company"]
    names = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))) for _ in range(500)]

    def stripped(name):
        again = True
        while again:
            again = False
            for s in sorted(T.LEGAL_SUFFIXES, key=len, reverse=True):
                if name.endswith(" " + s):
                    name, again = name[: -len(s) - 1], True
                    break
        return name

    assert column(spark, names, T.name_core) == [stripped(n) for n in names]


def test_addresses(spark):
    f = lambda x: F.concat_ws("|", T.normalize_address(x), T.postal_codes(T.normalize_address(x)), T.house_number(T.normalize_address(x)), T.address_numbers(T.normalize_address(x)))
    got = column(spark, ["12-A r de Lyon, 75001 PARIS 75001", "Null none", "Flat 9, 123456 x 1234567", "١٢ st 12345"], f)
    assert got[0] == "12-a rue de lyon 75001 paris 75001|75001 75001|12-a|12 75001"
    assert got[1] == "|||"
    assert got[2].split("|")[1:] == ["123456", "", "123456 1234567 9"]
    assert got[3] == "١٢ street 12345|12345|١٢|12345 ١٢"


def test_records_keep_other_columns_and_fill_nulls(spark):
    df = spark.createDataFrame([("S1-1", None, None, None, "kept")], "entity_id string, business_name string, business_address string, country string, other string")
    row = normalize_records(df).first()
    assert row["other"] == "kept" and all(row[c] == "" for c in NORMALIZED_COLUMNS)
    assert normalize_records(df.limit(0)).count() == 0
    assert normalize_record(spark, {"business_name": "A & B Ste"})["name_norm"] == "a and b societe"


def test_id_lists(spark):
    assert column(spark, [" S2-1, ,S3-2,", "", None], T.parse_id_list) == [["S2-1", "S3-2"], [], []]


def test_normalization_takes_one_expression_for_each_text(spark):
    """Regular expressions and lookups by token in the JVM take many times as long."""
    df = spark.createDataFrame([("S1-1", "12 Café Ltd & Co", "12 st null 75001", "FR")], "entity_id string, business_name string, business_address string, country string")
    own = normalize_records(df)
    plan = own.select("name_norm", "address_norm", "country_norm")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "regexp_replace(" not in plan
    assert list(own.select("name_norm", "name_core", "address_norm", "country_norm", "postal_codes").first()) == ["12 cafe limited and company", "12 cafe limited and", "12 street 75001", "fr", "75001"]


def test_postal_codes_are_whole_words(spark):
    values = ["12345 123456 1234567 1234", "a12345 12345b _12345 12345_", "12345-67890 12345,12345", "é12345 12345é ١٢٣٤٥", "", "12345"]
    want = [" ".join(t for t in re.split(r"\W+", x) if re.fullmatch(r"\d{5,6}", t)) for x in values]
    assert column(spark, values, T.postal_codes) == want
