"""Scalar functions against goldens and, for addresses, against the standard library."""

import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from weblake.functions import (
    date_path,
    expand_index,
    log_date,
    mask_field,
    source_key,
    split_first,
    split_last,
    target_day,
    target_day_of,
)


def apply(spark, values, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = frame.select("i", *columns).orderBy("i").collect()
    return [tuple(r)[1] if len(columns) == 1 else tuple(r)[1:] for r in rows]


MASKS = {
    "203.0.113.7": "203.0.0.0",
    "10.255.1.2": "10.0.0.0",
    "255.255.255.255": "255.0.0.0",
    "0.1.2.3": "0.0.0.0",
    "2001:db8:1:2::1": "2001:db8::",
    "2001:0DB8::": "2001:db8::",
    "64:ff9b::1": "64:ff9b::",
    "2a02:26f7:c9c8::1": "2a02:26f7::",
    "::1": "::",
    "::": "::",
    "::ffff:203.0.113.7": "::",
    "::1:2:3:4:5:6:7": "0:1::",
    "::1:2:3:4:5:10.0.0.1": "0:1::",
    "0:1:2:3:4:5:6:7": "0:1::",
    "fe80::1%eth0": "fe80::",
    "-": "-",
}
NO_ADDRESSES = [
    "", "1.2.3", "c-ip", "203.0.113.7, 10.0.0.1", "010.1.1.1", "256.1.1.1", "1.2.3.4.5", "1.2.3.4\n",
    ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::",
    "12345::", "g::", "::1.2.3", "1.2.3.4::", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%", "fe80::1%a%b", "1.2.3.4%eth0",
    ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:",
]


def test_mask_goldens(spark):
    assert apply(spark, list(MASKS), mask_field(F.col("v"))) == list(MASKS.values())


def test_invalid_addresses_mask_to_null(spark):
    assert apply(spark, NO_ADDRESSES, mask_field(F.col("v"))) == [None] * len(NO_ADDRESSES)
    for text in NO_ADDRESSES:
        with pytest.raises(ValueError):
            ipaddress.ip_address(text)


def stdlib_mask(text):
    try:
        version = ipaddress.ip_address(text).version
    except ValueError:
        return None
    bits = 8 if version == 4 else 32
    return str(ipaddress.ip_network(f"{text}/{bits}", strict=False).network_address)


def random_address(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return str(ipaddress.IPv4Address(rng.getrandbits(32)))
    groups = [rng.choice(["0", "0", "0000", f"{rng.getrandbits(16):x}", f"{rng.getrandbits(16):04X}"]) for _ in range(8)]
    if kind == 1:
        return str(ipaddress.IPv6Address(rng.getrandbits(128)))
    if kind == 2:
        return ":".join(groups)
    start = rng.randrange(0, 9)
    stop = rng.randrange(start, 9)
    head, tail = groups[:start], groups[stop:]
    if kind == 3 and len(tail) >= 2:
        tail[-2:] = [str(ipaddress.IPv4Address(rng.getrandbits(32)))]
    text = ":".join(head) + "::" + ":".join(tail)
    if kind == 4:
        # Damage: drop, double or replace one character.
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice(["", text[at] * 2, "z", ":", "."]) + text[at + 1 :]
    return text


def test_mask_agrees_with_the_standard_library(spark):
    rng = random.Random(7)
    texts = [random_address(rng) for _ in range(20_000)]
    got = apply(spark, texts, mask_field(F.col("v")))
    wrong = [(t, g, stdlib_mask(t)) for t, g in zip(texts, got) if g != stdlib_mask(t)]
    assert wrong == []


# The acceptance vectors of URI expansion and splitting.
EXPANDED = {
    "/": "/index.html",
    "/blog": "/blog/index.html",
    "/blog/post001": "/blog/post001/index.html",
    "/blog/post001/": "/blog/post001/index.html",
    "/blog/post001#section-a": "/blog/post001/index.html#section-a",
    "/blog/post001/?param=1&param=2#containing#and/": "/blog/post001/index.html?param=1&param=2#containing#and/",
    "/logo.svg": "/logo.svg",
    "/logo.svg/": "/logo.svg/index.html",
    "": "/index.html",
    "noslash": "noslash/index.html",
    "no.slash": "no.slash/index.html",
    "/v1.2/x": "/v1.2/x/index.html",
    "/a?x=/b.c": "/a/index.html?x=/b.c",
    "/a#b?c": "/a/index.html#b?c",
    "/ü/é": "/ü/é/index.html",
}


def test_expand_index(spark):
    assert apply(spark, list(EXPANDED), expand_index(F.col("v"))) == list(EXPANDED.values())


# The acceptance vectors of splitting at the first delimiter.
@pytest.mark.parametrize(
    "text, delimiter, parts",
    [
        ("/abc?d=ef", "?", ("/abc", "?d=ef")),
        ("/abc#def#ghi#jkl", "#", ("/abc", "#def#ghi#jkl")),
        ("/abc?d=ef", "#", ("/abc?d=ef", "")),
        ("/abc#", "#", ("/abc", "#")),
        ("", "/", ("", "")),
    ],
)
def test_split_first(spark, text, delimiter, parts):
    assert apply(spark, [text], *split_first(F.col("v"), delimiter)) == [parts]


# The acceptance vectors of splitting at the last delimiter.
@pytest.mark.parametrize(
    "text, delimiter, parts",
    [
        ("/abc?d=ef", "/", ("", "/abc?d=ef")),
        ("/abc/def/ghi/jkl", "/", ("/abc/def/ghi", "/jkl")),
        ("/abc?d=ef", "#", ("/abc?d=ef", "")),
        ("/abc/", "/", ("/abc", "/")),
        ("", "/", ("", "")),
    ],
)
def test_split_last(spark, text, delimiter, parts):
    assert apply(spark, [text], *split_last(F.col("v"), delimiter)) == [parts]


def test_log_date(spark):
    good = ["2022-01-03", "2022-1-3", "2024-02-29"]
    bad = ["2022-13-3", "2022-02-30", "22-1-3", "2022-01-03x", "bad", "", "+2022-1-3", "12022-1-3", "2022-1-3 "]
    assert apply(spark, good, log_date(F.col("v"))) == [
        datetime.date(2022, 1, 3), datetime.date(2022, 1, 3), datetime.date(2024, 2, 29),
    ]
    assert apply(spark, bad, log_date(F.col("v"))) == [None] * len(bad)


def test_target_day_keeps_the_offsets_own_day(spark):
    times = ["2020-04-28T07:20:20Z", "2020-05-01T00:30:00+09:00", "2020-03-01T23:59:59-08:00"]
    days = [datetime.date(2020, 4, 27), datetime.date(2020, 4, 30), datetime.date(2020, 2, 29)]
    assert apply(spark, times, target_day(F.col("v"))) == days
    assert [target_day_of(t) for t in times] == days


def test_date_path_and_source_key(spark):
    assert apply(spark, ["2022-1-3"], date_path(log_date(F.col("v")))) == ["2022/01/03/"]
    assert apply(spark, ["m/2022/01/03/a.gz", "a.gz", "m/2022/"], source_key(F.col("v"))) == ["a.gz", "a.gz", None]
