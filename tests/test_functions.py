import pytest
from pyspark.sql import functions as F

from netweir.functions import ip
from netweir.functions.labels import copy_label, equals, matches, series_key
from netweir.functions.timing import duration_seconds, elapsed_seconds


def column(spark, values, kind, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


NUMBERS = {
    0x0A000001: "10.0.0.1", 0xC0A80101: "192.168.1.1", 0xFFFFFFFF: "255.255.255.255",
    0x00000000: "0.0.0.0", 0xAC100064: "172.16.0.100",
}


def test_number_to_text_and_back(spark):
    assert column(spark, list(NUMBERS), "bigint", ip.u32_to_text) == list(NUMBERS.values())
    assert column(spark, list(NUMBERS.values()), "string", ip.text_to_u32) == list(NUMBERS)
    mapped = column(spark, list(NUMBERS), "bigint", ip.u32_to_binary)
    assert [m[-4:] for m in mapped] == [n.to_bytes(4, "big") for n in NUMBERS]
    assert {len(m) for m in mapped} == {16}


def test_binary_text(spark):
    values = [bytes(10) + b"\xff\xff\x0a\x00\x00\x01", bytes.fromhex("20010db8000000000000000000000001"), b""]
    assert column(spark, values, "binary", ip.binary_to_text) == [
        "10.0.0.1", "2001:0db8:0000:0000:0000:0000:0000:0001", "",
    ]


def test_strip_cidr(spark):
    given = ["10.0.0.1/32", "10.0.0.1/24", "192.168.1.1/16", "10.0.0.1", "2001:db8::1/128", ""]
    assert column(spark, given, "string", ip.strip_cidr) == [
        "10.0.0.1", "10.0.0.1", "192.168.1.1", "10.0.0.1", "2001:db8::1", "",
    ]


@pytest.mark.parametrize("plen", [0, 1, 7, 8, 9, 20, 63, 64, 65, 96, 104, 116, 127, 128])
def test_mask_every_boundary(spark, plen):
    address = bytes(range(0xF0, 0x100))
    number = int.from_bytes(address, "big")
    want = (number >> (128 - plen) << (128 - plen)).to_bytes(16, "big")
    assert bytes(column(spark, [address], "binary", lambda c: ip.mask(c, plen))[0]) == want


def test_mask_rejects_bad_length():
    with pytest.raises(ValueError):
        ip.mask(None, 129)


def test_networks(spark):
    v4 = bytes(10) + b"\xff\xff\x0a\x01\x02\x03"
    v6 = bytes.fromhex("20010db8aaaabbbbccccddddeeeeffff")
    got = [bytes(b) for b in column(spark, [v4, v6], "binary", ip.network)]
    assert got == [bytes(10) + b"\xff\xff\x0a\x01\x02\x00", bytes.fromhex("20010db8aaaa" + "00" * 10)]


def test_tcp_flags(spark):
    assert column(spark, [0, 2, 18, 255], "int", ip.tcp_flag_names) == [
        "", "SYN", "SYN,ACK", "FIN,SYN,RST,PSH,ACK,URG,ECE,CWR",
    ]


def test_durations(spark):
    given = ["1h", "5m", "30s", "1h30m", "250ms", "", None, "15m30s"]
    assert column(spark, given, "string", lambda c: duration_seconds(c, 3600)) == [
        3600.0, 300.0, 30.0, 5400.0, 0.25, 3600.0, 3600.0, 930.0,
    ]


def test_elapsed_is_rounded(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:01.5' b")
    assert rows.select(elapsed_seconds(F.col("a"), F.col("b"))).first()[0] == 2


def test_series_key_is_stable_and_skips_empty(spark):
    rows = spark.sql("SELECT map('b','2','a','1','c','') x, map('a','1','b','2') y")
    got = rows.select(series_key(F.col("x")), series_key(F.col("y")), series_key(F.col("y"), ["a"])).first()
    assert got[0] == got[1] == '{"a":"1","b":"2"}'
    assert got[2] == '{"b":"2"}'


def test_matchers(spark):
    rows = spark.sql("SELECT map('job','snmp2') m")
    got = rows.select(
        matches(F.col("m"), "job", "snmp|gnmic"), matches(F.col("m"), "job", "snmp.*"),
        equals(F.col("m"), "absent", ""), equals(F.col("m"), "job", "snmp2"),
    ).first()
    assert tuple(got) == (False, True, True, True)


def test_copy_label(spark):
    rows = spark.sql("SELECT map('source','r1','device','old') m, map('device','old') n")
    got = rows.select(copy_label(F.col("m"), "source", "device"), copy_label(F.col("n"), "source", "device")).first()
    assert got[0] == {"source": "r1", "device": "r1"} and got[1] == {"device": "old"}


def test_text_that_is_no_address_or_duration(spark):
    bad = ["10.0.0.300", "2001:db8::1", "bad", "", "1.2.3", "1.2.3.4.5", " 1.2.3.4", None]
    assert column(spark, bad, "string", ip.text_to_u32) == [None] * len(bad)
    given = ["1.2.3s", "2h5x", "-1h", "1.5h", "100us", "0s", "h", "+2m", "1h "]
    assert column(spark, given, "string", lambda c: duration_seconds(c, 3600)) == [3600.0, 3600.0, -3600.0, 5400.0, 1e-4, 3600.0, 3600.0, 120.0, 3600.0]
