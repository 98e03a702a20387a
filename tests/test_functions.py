"""Column expressions on literal cases."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import numbers, text
from fleetlens.functions.capture import with_groups
from fleetlens.functions.settings_text import decode_lines
from fleetlens.operators.settings import valid_booleans


def apply(frame, values, expr, kind="string"):
    rows = frame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_account_names(frame):
    units = ["hello", "hello/0", "X" * 70]
    plain = apply(frame, units, text.account_name)
    assert plain[:2] == ["juju_hello"] * 2
    assert len(plain[2]) == 63 and plain[2].endswith("d83abbe4d9ddcab942fe8fe92d387470")
    assert apply(frame, units[:2], lambda c: text.account_name(c, "admin")) == ["jujuadmin_hello"] * 2
    assert apply(frame, units[:1], lambda c: text.account_name(c, "replication")) == ["jujurepl_hello"]


def test_identifiers(frame):
    cases = {
        "hello": '"hello"',
        "Hello": '"Hello"',
        "'": '"\'"',
        '"': '""""',
        "\\": '"\\"',
        '\\"': '"\\"""',
        "\\ aargh слон": 'U&"\\\\ aargh \\0441\\043b\\043e\\043d"',
        "é": 'U&"\\00e9"',
        "\U0001f600": 'U&"\\+01f600"',
    }
    assert apply(frame, list(cases), text.quote_ident) == list(cases.values())


def test_address_ranges(frame):
    cases = {
        "hostname": "hostname",
        "192.168.1.1": "192.168.1.1/32",
        "192.168.1.0/24": "192.168.1.0/24",
        "::whatever::": "::whatever::/128",
        "::whatever::/64": "::whatever::/64",
        "unparseable nonsense": "unparseable nonsense",
    }
    assert apply(frame, list(cases), text.addr_range) == list(cases.values())


def test_split_rules(frame):
    a, b = "local all sso md5", "local all ssoadmin md5"
    cases = [f"{a},{b}", f"{a},\n{b}", f"{a}\n{b}", "host a b, c d", f"{a}\n"]
    assert apply(frame, cases, text.split_rules) == [
        [a, b],
        [a, "\n" + b],
        [a, b],
        ["host a b, c d"],
        [a],
    ]


def test_port(frame):
    cases = ["# rubbish\n Port = 1234 # why\n", "port='1235'\n# x", "", "export = 3"]
    found = apply(frame, cases, lambda c: text.extract_setting(c, "port"))
    assert found == [1234, 1235, 5432, 5432]


@pytest.mark.parametrize(
    ("line", "key", "value"),
    [
        ("key_1 = value", "key_1", "value"),
        ("Key_2 ='quoted valu3'", "key_2", "quoted valu3"),
        ("key_3= 'foo \"bar\"'", "key_3", 'foo "bar"'),
        ("key_4='''bar\\''", "key_4", "'bar'"),
        ("key_5=''", "key_5", ""),
        ("key_6='#'", "key_6", "#"),
        ("key_7=42", "key_7", "42"),
        ("key_8=3.142", "key_8", "3.142"),
        ("key_9=-1", "key_9", "-1"),
        ("key value # note", "key", "value"),
        ("key = 'a\x01b'", "key", "a\x01b"),
    ],
)
def test_setting_lines(frame, line, key, value):
    (row,) = decode_lines(frame([(line,)], "line string")).collect()
    assert (row.key, row.value, row.error) == (key, value, None)


@pytest.mark.parametrize(
    ("line", "error"),
    [
        ("=", "Missing key"),
        ("word", "Missing key"),
        ("key=", "Missing value"),
        ("key='unterminated", "Badly quoted value"),
        ("key='unterminated 2 # comment", "Badly quoted value"),
        ("key='unte''''", "Badly quoted value"),
        ("key='\\'", "Badly quoted value"),
        ("key = a b", "Badly quoted value"),
    ],
)
def test_setting_errors(frame, line, error):
    (row,) = decode_lines(frame([(line,)], "line string")).collect()
    assert (row.key, row.value, row.error) == (None, None, error)


def test_blank_lines_drop_out(frame):
    lines = frame([("# A comment",), ("",), ("  # Another comment ",), ("   ",)], "line string")
    assert decode_lines(lines).count() == 0


def test_groups_of_a_text_that_does_not_fit(frame):
    df = with_groups(frame([("ab1",), ("zz",)], "t string"), F.col("t"), r"^([a-y]+)(\d)?$", 2)
    assert {r.t: r._groups for r in df.collect()} == {"ab1": ["ab", "1"], "zz": ["zz"]}


def test_units(frame):
    cases = [
        ("10 kB", "kB", 10.0),
        ("10 MB", "GB", 10 / 1024),
        ("800 kB", "8kB", 100.0),
        ("1TB", "MB", 1048576.0),
        ("42", "MB", 42.0),
        ("1s", "ms", 1000.0),
        ("1d", "h", 24.0),
        ("1 min", "d", 1 / 1440),
        ("-1", "8kB", -1.0),
    ]
    df = frame([(i, t, u) for i, (t, u, _) in enumerate(cases)], "i int, t string, u string")
    got = df.select("i", numbers.convert_unit(F.col("t"), F.col("u")).alias("y")).orderBy("i")
    assert [r.y for r in got.collect()] == pytest.approx([c[2] for c in cases])


def test_unit_errors(frame):
    cases = [
        ("10 MB", "d", "Cannot convert MB to d"),
        ("MB", "MB", "Invalid number or unit"),
        ("10.5MB", "kB", "Invalid number or unit"),
        ("1 KB", "kB", "Unknown conversion unit 'KB'. Units are case sensitive."),
    ]
    df = frame([(i, t, u) for i, (t, u, _) in enumerate(cases)], "i int, t string, u string")
    c, u = F.col("t"), F.col("u")
    got = df.select(
        "i", numbers.quantity_error(c, u).alias("e"), numbers.convert_unit(c, u).alias("y")
    ).orderBy("i")
    assert [(r.e, r.y) for r in got.collect()] == [(c[2], None) for c in cases]


def test_log_positions(frame):
    position = ["16/B374D848", "0/0", "FFFFFFFF/FFFFFFFF", None]
    factor = 16 * 1024 * 1024 * 255
    top = 0xFFFFFFFF
    expected = [0x16 * factor + 0xB374D848, 0, top * factor + top, None]
    assert apply(frame, position, numbers.lsn_bytes) == expected
    wide = apply(frame, position[:1], lambda c: numbers.lsn_bytes(c, legacy=False))
    assert wide == [0x16 * 2**32 + 0xB374D848]


def test_versions_compare_by_number(frame):
    got = apply(frame, ["9.5", "10", "9.10.3", "9.3", "9.5.1"], lambda c: numbers.at_least(c, "9.5"))
    assert got == [True, True, True, False, True]


def test_durations(frame):
    got = apply(frame, [123456, 0, 86399], numbers.nice_age, "bigint")
    assert got == [
        "1 days, 10 hours, 17 minutes and 36 seconds",
        "0 days, 0 hours, 0 minutes and 0 seconds",
        "0 days, 23 hours, 59 minutes and 59 seconds",
    ]


def test_booleans_are_unique_beginnings():
    words = valid_booleans()
    assert "o" not in words
    assert {"on", "of", "off", "t", "f", "y", "n", "0", "1"} <= set(words)
