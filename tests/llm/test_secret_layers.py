"""Secrets under layers that are cut, glued, wrapped, nested or not UTF-8."""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest

from meterline.llm import op3_secrets
from meterline.llm.op3_secrets import find_secrets, scan_layers

SECRET = b"token=abcdefgh1234"
rng = random.Random(3)
NOISE = bytes(rng.randrange(256) for _ in range(300))


def b64(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def raw_deflate(raw: bytes) -> bytes:
    press = zlib.compressobj(wbits=-15)
    return press.compress(raw) + press.flush()


PROSE = b"nothing to see here, only some words in a row. "
CASES = {
    "gzip members": b64(gzip.compress(PROSE) + gzip.compress(SECRET)),
    "bz2 streams": b64(bz2.compress(PROSE) + bz2.compress(SECRET)),
    "xz streams": b64(lzma.compress(PROSE) + lzma.compress(SECRET)),
    "lzma": b64(lzma.compress(PROSE + SECRET, lzma.FORMAT_ALONE)),
    "zlib": b64(zlib.compress(PROSE + SECRET)),
    "raw deflate": b64(raw_deflate(PROSE + SECRET)),
    "utf-16 le": b64(SECRET.decode().encode("utf-16-le")),
    "utf-16 be": b64(SECRET.decode().encode("utf-16-be")),
    "utf-16 with a mark": b64(SECRET.decode().encode("utf-16")),
    "binary record": b64(NOISE + b" " + SECRET + b"\0" + NOISE),
    "glued to auth_": "auth_" + b64(PROSE + SECRET),
    "glued to v1/": "v1/" + b64(PROSE + SECRET),
    "glued to auth_, compressed": "auth_" + b64(gzip.compress(SECRET)),
    "one letter more": b64(PROSE + SECRET + b"..").rstrip("=") + "A" * (1 + -len(b64(PROSE + SECRET + b"..").rstrip("=")) % 4),
    "wrapped lines": base64.encodebytes(gzip.compress(NOISE + SECRET)).decode(),
    "percent run with an odd byte": "%ff%74%6f%6b%65%6e%3d%61%62%63%64%65%66%67%68%31",
    "nested": b64(gzip.compress(b64(bz2.compress(b64(SECRET).encode())).encode())),
    "gzip in gzip, long": b64(gzip.compress(gzip.compress(PROSE * 120_000 + SECRET, 0))),
    "base64 over the end of a part": b64(gzip.compress(b"x " * (2 << 20) + b"yy" + b64(PROSE * 200 + SECRET).encode())),
    "base64 of more than a part": b64(gzip.compress(b". " + b64(PROSE * 130_000 + SECRET).encode())),
    "secret over the end of a part": b64(gzip.compress(b"x " * ((2 << 20) - 4) + SECRET)),
}


@pytest.mark.parametrize("name", CASES)
def test_the_secret_is_found(name):
    text = "see " + CASES[name] + " end"
    _, spans, _ = scan_layers(text)
    assert spans and all(4 <= a < b <= len(text) - 4 for a, _, b in spans), name


def test_what_holds_no_secret_gives_no_span():
    for raw in (NOISE, PROSE, gzip.compress(PROSE), raw_deflate(PROSE), PROSE.decode().encode("utf-16-le")):
        assert scan_layers("see " + b64(raw) + " end")[1] == []


def test_a_cut_or_damaged_stream_gives_what_comes_before_the_damage():
    whole = gzip.compress(SECRET + b" " + NOISE * 50)
    assert scan_layers(b64(whole[:400]))[1]
    assert scan_layers(b64(gzip.compress(SECRET) + b"rubbish that is no member"))[1]


def test_the_size_of_a_part_changes_nothing(monkeypatch):
    text = " ".join(CASES[n] for n in ("gzip members", "bz2 streams", "xz streams", "raw deflate", "wrapped lines", "nested"))
    want = scan_layers(text)[1]
    monkeypatch.setattr(op3_secrets, "PART_BYTES", 1 << 16)
    assert scan_layers(text)[1] == want


def test_repeated_and_very_long_rows(spark):
    long = "word " * 400_000 + CASES["gzip members"]
    rows = [(1, CASES["nested"]), (1, CASES["nested"]), (2, long), (3, None), (None, "")]
    found = {(r.doc_id, r.spans) for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 4 and {(3, ""), (None, "")} <= found
    (own,) = [s for i, s in found if i == 2]
    assert own == f"assign:2000000:{len(long)}"
