"""SPSS files: round trips, compressed rows made by hand, refusals."""

import struct

import pytest

from textloom.operators import export
from textloom.sources import files, sav


@pytest.fixture()
def survey(spark, tmp_path):
    rows = [(1, 0, "parkeren én wachten", None), (2, 1, None, 2.5), (3, None, "x" * 200, -1.0), (4, 7, "", 0.0)]
    df = spark.createDataFrame(rows, "id long, Q1_mentioned int, Open_Answer string, score double")
    path = str(tmp_path / "survey.sav")
    sav.write_sav(export.with_labels(df, {"Q1_mentioned": "Parking"}), path)
    return path


def test_round_trip_with_labels(spark, survey):
    back = files.read_survey(spark, survey.removesuffix(".sav"), "sav")
    assert back.columns == ["id", "Q1_mentioned", "Open_Answer", "score"]
    assert files.variables(back)["Q1_mentioned"] == "Parking"
    got = [tuple(r) for r in back.orderBy("id").collect()]
    assert got == [(1.0, "Niet genoemd", "parkeren én wachten", None), (2.0, "Wel genoemd", "", 2.5), (3.0, None, "x" * 200, -1.0), (4.0, "7", "", 0.0)]
    plain = sav.read_sav(spark, survey, value_labels=False).orderBy("id").collect()
    assert [r["Q1_mentioned"] for r in plain] == [0.0, 1.0, None, 7.0]


def test_compressed_rows(spark, survey, tmp_path):
    data = open(survey, "rb").read()
    d = sav.Dictionary(data)
    head = bytearray(data[: d.start])
    struct.pack_into("<i", head, 72, 1)
    slots, body = list(d._slots(data)), b""
    for k in range(0, len(slots), 8):
        codes, literal = b"", b""
        for s in slots[k : k + 8]:
            x = struct.unpack("<d", s)[0]
            small = x == int(x) and -99 <= x <= 151 if abs(x) < 1e9 else False
            codes += bytes([int(x) + 100 if small else 254 if s == b" " * 8 else 255 if x < -1e308 else 253])
            literal += s if codes[-1] == 253 else b""
        body += codes.ljust(8, b"\xfc") + literal
    path = str(tmp_path / "packed.sav")
    open(path, "wb").write(bytes(head) + body)
    key = lambda p: sorted(map(str, sav.read_sav(spark, p).collect()))
    assert key(path) == key(survey)


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError):
        sav.read_sav(spark, str(tmp_path / "missing"))
    (tmp_path / "bad.sav").write_bytes(b"no such thing")
    with pytest.raises(ValueError):
        sav.read_sav(spark, str(tmp_path / "bad.sav"))
    with pytest.raises(ValueError):
        sav.write_sav(spark.createDataFrame([("y" * 300,)], "a string"), str(tmp_path / "long.sav"))
    sav.write_sav(spark.createDataFrame([], "a string, b double"), str(tmp_path / "none.sav"))
    assert sav.read_sav(spark, str(tmp_path / "none.sav")).count() == 0
