import pytest
from pyspark.sql import functions as F

from molweave.functions import text as tx
from molweave.functions.chem import element_of_pdbqt, element_of_type, vdw_radius
from molweave.functions.labels import compound_type, external_id, label_of
from molweave.functions.report import image_address, percent, score_band


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    out = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


@pytest.mark.parametrize(
    "function, cases",
    [
        (tx.lenient_double, {"-7,5e3": -7.5, "ab12.25": 12.25, "": 0.0, "-": 0.0, "x-3": -3.0, "5.": 5.0, "a-b7": 0.0}),
        (tx.lenient_int, {"-7,5": -7, "skip 12 3": 12, "": 0, "-": 0}),
        (tx.first_identifier, {" C ": "C", "1HB'": "HB'", "": "", " 12": "", "Cl-": "Cl"}),
        (tx.ascii_lower, {"AbZ": "abz", "Ä1": "Ä1"}),
        (tx.clean_name, {"a (b), c_|-9": "abc_|-9"}),
        (tx.short_id, {"yes_331_long_name": "331", "yes_331": "", "": ""}),
        (tx.base_id, {"ZINC0012": "0012"}),
        (tx.decimal_comma, {"-7,25": -7.25, "1.5": 1.5, "x": None}),
        (lambda c: tx.tokens(c, "/.]"), {"a//b.c]": ["a", "b", "c"], "": []}),
        (element_of_type, {"C.ar": "C", "H": "H", "N.pl3": "N"}),
        (vdw_radius, {"H": 1.2, "Br": 1.85, "Zn": 1.7}),
        (label_of, {"YES_1": "yes", "not_2": "not", "ZINC3": None}),
        (external_id, {"yes_331": "331"}),
        (compound_type, {"Yes_1": "inhibitor", "not_1": "notinhibitor", "other": "notinhibitor"}),
        (image_address, {"1234": "http://www.rcsb.org/pdb/images/1234_270.gif", "12345": "http://zinc.docking.org/img/sub/12345.gif"}),
    ],
)
def test_text_functions(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_path_parts(spark):
    cases = {
        "/a/b.c/d": ("/a/b.c/", "d", ""),
        "/a/c.tar.gz": ("/a/", "c.tar", "gz"),
        "x.txt": ("", "x", "txt"),
        "x": ("", "x", ""),
        "/x/.hid": ("/x/", "", "hid"),
    }
    assert [tuple(r) for r in apply(spark, tx.path_parts, list(cases))] == list(cases.values())


def test_fixed4_rounds_like_c(spark):
    values = [a / b for b in (3, 7, 32, 48, 160, 800, 2048) for a in range(b + 1)]
    values += [1 - v for v in values]
    assert apply(spark, tx.fixed4, values, "double") == ["%.4f" % v for v in values]


def test_pdbqt_element(spark):
    line = "ATOM      9 {} ABC B  5        1.250  -2.500   3.750  0.00  0.00    -0.125 {}"
    cases = {
        line.format("HD21", "HD"): "H",
        line.format(" C  ", "C "): "C",
        line.format("CL  ", "Cl"): "CL",
        line.format(" OA ", "OA"): "O",
    }
    assert apply(spark, element_of_pdbqt, list(cases)) == list(cases.values())


def test_report_columns(spark):
    assert apply(spark, score_band, [1.49, 1.5, 1.69, 1.7], "double") == ["red", "", "", "green"]
    assert apply(spark, percent, [0.999, 0.29, 1.0], "double") == [99, int(0.29 * 100), 100]
