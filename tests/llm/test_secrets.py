import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import secrets as S

ALL = {"assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12), "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)}


def brute(text):
    spans = [(m.start(), list(ALL).index(k), k, m.end()) for k, (p, ok) in ALL.items() for m in p.finditer(text or "") if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(spans)]


PARTS = ["password", "passwd", "SECRET", "token", "api_key", "apikey", "ApiKey", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "abc", "f", "é", "\n", "x9+/=-._", "ghp_", "ſecret", "toKen", "ABCDEFGHIJKL"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=5))
def test_base_spans_as_a_plain_scan_has_them(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    got = [[(s["kind"], s["start"], s["end"]) for s in row if s["kind"] in S.BASE_KINDS] for out in S._scan_batches([batch]) for row in out.column(1).to_pylist()]
    assert got == [brute(t) for t in texts]


def test_checksums_and_cases(spark):
    body = b"abcdefghijABCDEFGHIJ0123456789"
    good = (b"ghp_" + body + S.crc62(body)).decode()
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    rows = [(1, f"é {good}."), (2, bad), (3, None), (4, ""), (None, f"npm_{good[4:]}"), (3, "token=abcdefghijkl"), (5, "é" * 100_000 + " token: abcdefghijklm")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string")
    got = {(r.doc_id, r.spans) for r in S.digest(S.find_secrets(docs)).collect()}
    assert got == {(1, "github:2:42"), (2, ""), (3, ""), (4, ""), (None, "npm:0:40"), (3, "assign:0:18"), (5, "assign:100001:100021")}
    assert S.find_secrets(docs.limit(0)).count() == 0


def test_age_keys():
    # a valid key is made by trying the last six characters' polynomial: flip one sign and it must fail
    data = "Q" * 52
    values = [ord(c) >> 5 for c in "age-secret-key-"] + [0] + [ord(c) & 31 for c in "age-secret-key-"] + [0] * 52 + [0] * 6
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, poly in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            state ^= poly if top >> i & 1 else 0
    state ^= 1
    key = "AGE-SECRET-KEY-1" + data + "".join(S.BECH32[state >> 5 * (5 - i) & 31] for i in range(6)).upper()
    keywords = S.automaton(S.KEYWORDS)
    assert S.scan(key.encode(), keywords) == [(0, 74, 5)]
    assert S.scan((key[:20] + "P" + key[21:]).encode(), keywords) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in S.BASE_KINDS] for r in S.find_secrets(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}
    assert any(got.values())
