import base64
import datetime

from pyspark.sql import functions as F

from gleaner.functions import content as C


def binary(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x binary")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_base64_is_tolerant(spark):
    cases = {
        "YWJj\nZGVm\n": b"abcdef",
        "%%%": b"",
        "YWJjZ": b"",
        "YW%Jj": b"abc",
        "YWI=": b"ab",
        "YWI": b"",
        "YQ==": b"a",
        "YQ=": b"",
        "": b"",
    }
    df = spark.createDataFrame(list(cases.items()), "x string, want binary")
    got = df.select("want", C.payload_bytes(F.lit("base64"), F.col("x")).alias("got")).collect()
    assert [bytes(r.got) for r in got] == [bytes(r.want) for r in got]


def test_payload_falls_back_to_download(spark):
    rows = [("base64", "YQ==", b"no"), ("none", "YQ==", b"raw"), ("base64", None, b"raw"), ("none", None, None)]
    df = spark.createDataFrame(rows, "e string, c string, d binary")
    got = df.select(C.payload_bytes(F.col("e"), F.col("c"), F.col("d")).alias("b")).collect()
    assert [bytes(r.b) for r in got] == [b"a", b"raw", b"raw", b""]


def test_text_screen(spark):
    cases = [
        (b"a" * 5000 + b"\0", False),
        (b"\x01" * 81 + b"a" * 4015, True),
        (b"\x01" * 82 + b"a" * 4014, False),
        (b"a" * 4096 + b"\x01" * 4096, True),
        (b"\t\n\r\x0b\x0c" * 10, True),
        (b"", True),
        ("é".encode() * 100, True),
        (b"\xff\xfe" * 100, True),
        (b"\x01" + b"a" * 49, False),
        (b"\x01" + b"a" * 50, True),
    ]
    assert binary(spark, [c[0] for c in cases], lambda c: C.is_text(c, C.TEXT_TEST_WINDOW)) == [c[1] for c in cases]


def test_cut_may_split_a_character(spark):
    long = b"a" * 65537
    straddling = b"a" * 65535 + "é".encode()
    got = binary(spark, [long, straddling], lambda c: C.cut_bytes(c, C.MAX_BYTES_PER_FILE))
    assert [len(g) for g in got] == [65536, 65536]
    assert bytes(got[1])[-1:] == "é".encode()[:1]
    assert binary(spark, [straddling], lambda c: C.is_text(C.cut_bytes(c, C.MAX_BYTES_PER_FILE), C.TEXT_TEST_WINDOW)) == [True]


def test_large_round_trip(spark):
    data = bytes(range(1, 256)) * 400
    df = spark.createDataFrame([(base64.encodebytes(data).decode(),)], "x string")
    assert bytes(df.select(C.payload_bytes(F.lit("base64"), F.col("x"))).first()[0]) == data


def test_stamp(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 31, 23, 59, 59),)], "t timestamp_ntz")
    assert df.select(C.utc_stamp(F.col("t"))).first()[0] == "2024-01-31T23:59:59Z"


def test_text_of_broken_bytes(spark):
    assert binary(spark, ["é".encode(), b"a\xffb"], C.text_of) == ["é", "a\ufffdb"]
