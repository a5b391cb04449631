import pytest

from edgeloom.operators import extract
from edgeloom.operators.numbered import masked
from edgeloom.queries import CASES


@pytest.mark.parametrize("case", sorted(CASES))
def test_shared_findings_are_the_files_own(case):
    language, text, _ = CASES[case]
    for key in ("0", "7", "10", "123456"):
        own = text.replace("{k}", key)
        code = extract.cells(own) if language == "notebook" else [own]
        assert extract.analyse(own, language) == extract.analysed(code, language, {}, True)


def test_files_of_one_numbered_name_are_analysed_once():
    extract.shared.cache_clear()
    for k in range(50):
        for language, text, _ in CASES.values():
            extract.analyse(text.replace("{k}", str(k)), language)
    info = extract.shared.cache_info()
    assert info.misses == info.hits // 49 <= len(CASES)  # three cases have other numbers, too, or put names together
    assert info.misses >= 22


def test_what_could_change_with_the_number_is_not_masked():
    sql = "SELECT 1 FROM s12.orders o JOIN s12.customers c ON o.cid = c.id WHERE o.total > 3"
    assert masked(sql, False) == (sql.replace("s12", "s0"), "s12", "s0")
    for more in (" -- s13", " -- S12", " -- cols5", " -- é"):
        assert masked(sql + more, False) is None
    for code in ('spark.table("s" "12.o")', 'spark.table("s" + "12.o")', 'spark.table(f"{a}s12.o")', 'spark.table("\\x7312.o")'):
        assert masked(f'a = spark.table("s99.orders_of_all_customers_everywhere_{code}', True) is None
    joined = "SELECT 1 FROM a.t x JOIN b.t y ON s12(x.k) = s12(y.k) AND x.some_long_name = y.some_long_name"
    assert extract.analyse(joined, "sql").joins[0]["condition"] == "S12(a.t.k) = S12(b.t.k) AND a.t.some_long_name = b.t.some_long_name"


def test_only_what_is_asked_for_is_returned(spark):
    files = spark.createDataFrame([(1, "sql", "SELECT 1 FROM a.t x JOIN b.t y ON x.k = y.k"), (2, "sql", None)], "id long, language string, text string")
    found = extract.extract(files, parts=["joins", "errors"], fields=["left_table", "condition"])
    assert found.columns == ["id", "language", "joins", "errors"]
    assert [(r["id"], [tuple(j) for j in r["joins"]]) for r in found.orderBy("id").collect()] == [(1, [("a.t", "a.t.k = b.t.k")]), (2, [])]
