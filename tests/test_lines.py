import pytest
from pyspark.sql import functions as F

from hostsieve.functions import features as ft
from hostsieve.functions.lines import DEFAULT, Field, LineFormat, network, timestamp_pattern

LINES = [
    ("2025-04-04T14:45:32.458123Z NXDOMAIN 192.168.3.152 10.10.0.3 test.com AAAA 192.168.15.34 196b", ""),
    ("2025-04-04T14:45:32.458123Z NXDOMAIN 192.168.3.152 10.10.0.3 test.com AAAA fe80::1 196b", ""),
    ("2025-04-04T14:45:32.458123Z NXDOMAIN 192.168.3.300 10.10.0.3 test.com A 192.168.15.34 196b", "client_ip"),
    ("2025-04-04 NXDOMAIN 192.168.3.1 10.10.0.3 -a.com MX 192.168.15.34 196b", "timestamp,domain_name,record_type"),
    ("a b", "field_count"),
    ("", "field_count"),
]


def test_parse(spark):
    df = DEFAULT.parse(spark.createDataFrame(LINES, "value string, want string"))
    for row in df.select("want", F.array_join("invalid_fields", ",").alias("got")).collect():
        assert row.got == row.want


@pytest.mark.parametrize(("ip", "prefix", "want"), [("192.168.1.1", 24, "192.168.1.0"), ("192.168.1.1", 12, "192.160.0.0"), ("0.0.0.1", 24, "0.0.0.0"), ("255.255.255.1", 23, "255.255.254.0")])
def test_network(spark, ip, prefix, want):
    assert spark.range(1).select(network(F.lit(ip), prefix)).first()[0] == want


def test_format_is_checked():
    with pytest.raises(ValueError):
        LineFormat((Field("timestamp", "timestamp", "%Y"),))
    with pytest.raises(ValueError):
        LineFormat((*DEFAULT.fields, Field("batch_id", "ip")))
    assert timestamp_pattern("%Y-%m-%dT%H:%M:%S.%fZ") == "yyyy-M-d'T'H:m:s.SSSSSS'Z'"


def test_features(spark):
    df = ft.with_levels(spark.createDataFrame([("zz.aaaa.com.",)], "domain_name string")).select(*(c.alias(n) for n, c in ft.all_features().items()))
    row = df.first()
    assert len(df.columns) == 44 + 1 - 1
    assert (row.label_length, row.label_max, row.label_average) == (3, 2, 11)
    assert row.freq_z == pytest.approx(2 / 11)
    assert row.secondleveldomain_entropy == 0 and row.thirdleveldomain_full == 1


@pytest.mark.parametrize(("text", "form", "ok"), [("04/Apr/2025:02:45:32 PM", "%d/%b/%Y:%I:%M:%S %p", True), ("2025 094", "%Y %j", True), ("4 april 2025", "%d %B %Y", True), ("04/Foo/2025", "%d/%b/%Y", False)])
def test_further_time_codes(spark, text, form, ok):
    from hostsieve.functions.lines import is_timestamp

    assert spark.range(1).select(is_timestamp(F.lit(text), form)).first()[0] is ok
