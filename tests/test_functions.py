from __future__ import annotations

import random

import pytest

from airsift.functions import measures, text
from airsift.labels import HIDDEN_SSID


def evaluate(spark, sql, values, kind="string"):
    """The expression over column `c` for each value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}")
    rows = df.selectExpr("i", f"{sql} AS r").orderBy("i").collect()
    return [row.r for row in rows]


def check(spark, sql, cases, kind="string"):
    assert dict(zip(cases, evaluate(spark, sql, list(cases), kind))) == cases


def test_first_value(spark):
    cases = {"": "", "a,b": "a", " a , b": "a", ",b": "", "a": "a", "\x1c a　": "a"}
    check(spark, text.first_value("c"), cases)
    assert evaluate(spark, text.first_value("c"), [None]) == [""]


def test_strip_equals_unicode_strip(spark):
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    values = [f"{c}{c}x{c}y{c}" for c in text.WHITESPACE] + ["", "  ", "é\xa0"]
    assert evaluate(spark, text.strip("c"), values) == [v.strip() for v in values]


def test_mac_addresses(spark):
    valid = {
        "3c:a7:ae:00:00:0a": True,
        "3c-a7-ae-00-00-0a": False,
        "3c:a7:ae:00:00": False,
        "3c:a7:ae:00:00:0a:": False,
        "x3c:a7:ae:00:00:0a": False,
        "3c:a7:ae:00:00:0a\n": False,
        "": False,
    }
    check(spark, text.is_valid_mac("c"), valid)
    check(spark, text.normalize_mac("c"), {" 3C:A7:AE:00:00:0A,x": "3c:a7:ae:00:00:0a"})
    ignored = {
        "": True,
        "ff:ff:ff:ff:ff:ff": True,
        "01:00:5e:00:00:fb": True,
        "33:33:00:00:00:01": True,
        "01:80:c2:00:00:00": False,
    }
    check(spark, text.is_ignored_mac("c"), ignored)


def test_vendors(spark):
    from airsift.sources.dimensions import with_oui_vendor

    expected = {
        "": "Bilinmiyor",
        "02:11:22:00:00:00": "Private / Randomized MAC",
        "00:1b:63:00:00:00": "Apple",
        "00-1B-63-00-00-00": "Apple",
        "00:1a:79:00:00:00": "Cisco",
        "00:50:56:00:00:00": "Bilinmiyor",
        "3c:a7": "Bilinmiyor",
    }
    df = spark.createDataFrame([(m,) for m in expected], "mac string")
    label = f"{text.vendor_label('mac', 'oui_vendor')} AS vendor"
    rows = with_oui_vendor(df, "mac").selectExpr("mac", label).collect()
    assert {r.mac: r.vendor for r in rows} == expected
    local = {"02:x": True, "aa:x": True, "00:x": False, "3c:x": False, "zz:x": False, "": False}
    check(spark, text.is_locally_administered("c"), local)
    check(spark, text.normalize_oui("c"), {"a-b-c-d": "A:B:C", "a:b": "", "": ""})


def test_own_vendor_table_replaces_the_built_in_one(spark):
    from airsift.sources.dimensions import with_oui_vendor

    oui = spark.createDataFrame([("00:50:56", "V"), ("00:50:56", "V")], "oui string, vendor string")
    df = spark.createDataFrame([("00:50:56:1:2:3",), ("00:1b:63:1:2:3",)], "mac string")
    rows = with_oui_vendor(df, "mac", oui).collect()
    assert {r.mac: r.oui_vendor for r in rows} == {"00:50:56:1:2:3": "V", "00:1b:63:1:2:3": None}


def plain_decode(value):
    """The rule in plain words: hex of printable UTF-8 is decoded."""
    value = value.strip()
    if not value:
        return HIDDEN_SSID
    if len(value) % 2:
        return value
    try:
        shown = str(bytes.fromhex(value), "utf-8")
    except ValueError:
        return value
    return shown if shown and shown.isprintable() else value


def test_decode_ssid(spark):
    golden = {
        "4142": "AB",
        "4c61624e6574": "LabNet",
        "61 62 63": "abc",
        "cafe": "cafe",
        "1234": "1234",
        "0000": "0000",
        "c3a9": "é",
        "c2a0": "c2a0",
        "E2808B": "E2808B",
        "61 626 3": "61 626 3",
        "": HIDDEN_SSID,
        "6162630a": "6162630a",
        "0a616263": "0a616263",
    }
    check(spark, text.decode_ssid("c"), golden)
    rng = random.Random(1)
    values = [
        "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.randint(1, 8)))
        for _ in range(300)
    ]
    values += [chr(rng.randint(0x20, 0x24F)).encode().hex() for _ in range(300)]
    values += [w.encode().hex() for w in ("Ağ 1", "日本", "a\tb", "🙂", "x y", "a\n", "\n", "\u2028")]
    assert evaluate(spark, text.decode_ssid("c"), values) == [plain_decode(v) for v in values]


def test_signals_and_numbers(spark):
    cases = {
        "-67": -67,
        "-67.9": -67,
        "-30.9,-1": -30,
        " -5 ": -5,
        "+5.": 5,
        ".9": 0,
        "1e2": 100,
        "n/a": None,
        "nan": None,
        "inf": None,
        "1d": None,
        "1e999": None,
        "99999999999": None,
        "-": None,
        "": None,
        "\u3000-7\x1c,8": -7,
        "-7 8": None,
        ",-7": None,
    }
    check(spark, text.parse_signal("c"), cases)
    check(spark, text.parse_double("c"), {"1700000000.25": 1700000000.25, "x": None, "1f": None})


def test_subtypes(spark):
    cases = {"0x000c": "12", "0X20": "32", "12": "12", "0xzz": "0xzz"}
    check(spark, text.decimal_subtype("c"), cases)
    assert evaluate(spark, text.subtype_label("c", "CAST(NULL AS STRING)"), ["32"]) == ["Subtype 32"]


def test_mean_is_correctly_rounded(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(-100 * n, 0), n) for n in (rng.randint(1, 5000) for _ in range(3000))]
    # Three-decimal ties, exact and inexact in binary.
    pairs += [(-(2 * rng.randint(0, 9999) + 1) * n // 200, n) for n in (8, 40, 200, 600, 1000)] * 200
    df = spark.createDataFrame(pairs, "t bigint, n bigint")
    rows = df.selectExpr("t", "n", f"{measures.mean_2dp('t', 'n')} AS m").collect()
    assert all(r.m == round(r.t / r.n, 2) for r in rows)
    assert evaluate(spark, measures.mean_2dp("c", "0L"), [5], "bigint") == [None]


def test_times(spark):
    cases = {1700000000.5: "22:13:20", 1700000000.9999999: "22:13:21", 0.0: "00:00:00"}
    check(spark, measures.seen_time("c"), cases, "double")
    assert evaluate(spark, measures.seen_time("c"), [None, 1e300], "double") == ["—", "—"]


def test_levels_and_scales(spark):
    check(spark, measures.activity_level("c"), {249: "Düşük", 250: "Orta", 999: "Orta", 1000: "Yüksek"}, "int")
    check(spark, measures.handshake_status("c"), {3: "partial", 4: "strong_candidate"}, "int")
    scale = {-100.0: 0, -30.0: 100, -65.0: 50, -120.0: 0, 0.0: 100}
    check(spark, measures.signal_scale("c"), scale, "double")
    shares = [(n, m) for m in (1, 7, 100, 333) for n in range(m + 1)]
    df = spark.createDataFrame(shares, "n bigint, m bigint")
    rows = df.selectExpr("n", "m", f"{measures.share_of_max('n', 'm')} AS s").collect()
    assert all(r.s == int(r.n / r.m * 100) for r in rows)
    assert evaluate(spark, measures.share_of_max("c", "0L"), [0], "bigint") == [0]
    check(spark, measures.remaining("c", 25), {10: 0, 25: 0, 30: 5}, "bigint")


def test_display_texts(spark):
    check(spark, measures.grouped_number("c"), {1234567: "1,234,567", 0: "0"}, "bigint")
    dbm = [-56.25, -56.35, -80.0, -1234.56, -0.04]
    assert evaluate(spark, measures.dbm_text("c"), dbm, "double") == [f"{x:.1f} dBm" for x in dbm]
    check(spark, measures.signal_text("c"), {-56.12: "-56.12 dBm", -80.0: "-80.0 dBm"}, "double")
    assert evaluate(spark, measures.signal_text("c", "cli"), [None], "double") == ["bilinmiyor"]
    assert evaluate(spark, measures.channel_text("c", "report"), [None, "6"]) == ["Bilinmiyor", "6"]
    assert evaluate(spark, measures.ssid_text("c"), ["a", None]) == ["a", "<Gizli SSID>"]
    check(spark, measures.category_label("c"), {"signal": "SIGNAL"})
    assert evaluate(spark, measures.category_label("c"), [None]) == ["GENERAL"]
    assert evaluate(spark, measures.severity_label("c"), [None]) == ["BİLGİ"]


@pytest.mark.parametrize(
    ("strong", "partial", "verdict"),
    [(2, 5, "● Güçlü Aday (2)"), (0, 5, "● Kısmi (5)"), (0, 0, "● Bulunamadı")],
)
def test_verdicts(spark, strong, partial, verdict):
    assert evaluate(spark, measures.handshake_verdict("c", f"{partial}L"), [strong], "bigint") == [verdict]
