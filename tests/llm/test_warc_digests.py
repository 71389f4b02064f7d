"""Records by the digests that they claim: known ones are checked in any coding, others kept."""

import base64
import hashlib

import pytest

from jobweave.llm import warc

BLOCK = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<html><body><p>Some words</p></body></html>"
BODY = BLOCK.partition(b"\r\n\r\n")[2]


def claims(data):
    sha1, sha256 = hashlib.sha1(data).digest(), hashlib.sha256(data).digest()
    return [
        ("sha1:" + base64.b32encode(sha1).decode(), True), ("SHA1:" + base64.b32encode(sha1).decode().lower(), True), ("sha1:" + sha1.hex(), True), ("sha-256:" + sha256.hex().upper(), True),
        ("sha256:" + base64.b32encode(sha256).decode(), True), ("md5:" + hashlib.md5(data).hexdigest(), True), ("sha256:" + "0" * 64, False), ("sha1:" + "A" * 32, False), ("blake3:00", None), ("sha1:short", None), ("", None), (None, None),
    ]


@pytest.mark.parametrize("k", range(12))
def test_digests(k):
    claim, want = claims(BLOCK)[k]
    assert warc.agrees(claim, BLOCK) is want
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://a/"), ("WARC-Date", warc.DATE)]
    rows = warc.derived(warc.record([*fields, *([("WARC-Block-Digest", claim)] if claim else [])], BLOCK))
    assert [r[0] for r in rows] == (["invalid"] if want is False else ["metadata", "conversion"])
    claim, want = claims(BODY)[k]
    rows = warc.derived(warc.record([*fields, *([("WARC-Payload-Digest", claim)] if claim else [])], BLOCK))
    assert [r[-1] for r in rows] == [want, want] and rows[1][12] == "Some words"
