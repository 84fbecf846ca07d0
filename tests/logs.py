"""Raw log files for the tests."""

from __future__ import annotations

import gzip
from pathlib import Path

from weblake.schema import CDN_FIELDS

DEFAULTS = {
    "date": "2022-11-02", "time": "03:04:05", "x-edge-location": "NRT57-P1", "sc-bytes": "5120", "c-ip": "203.0.113.7",
    "cs-method": "GET", "cs-uri-stem": "/blog/index.html", "sc-status": "200", "cs-protocol": "https", "cs-bytes": "312",
    "time-taken": "0.012", "x-edge-response-result-type": "Hit", "c-port": "54321", "time-to-first-byte": "0.010",
}


def row(fields=CDN_FIELDS, **values):
    """One tab-separated record; keyword names use '_' for '-'."""
    named = {k.replace("_", "-"): v for k, v in values.items()}
    return "\t".join(named.get(f, DEFAULTS.get(f, "-")) for f in fields)


def head(fields=CDN_FIELDS):
    return ["#Version: 1.0", "#Fields: " + " ".join(fields)]


def write(path: Path, lines, newline="\n", compress=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "".join(line + newline for line in lines).encode()
    path.write_bytes(gzip.compress(text) if compress else text)
    return str(path)
