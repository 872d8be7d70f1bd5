import gzip
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import license_scan, pieces, queries, warc

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


# archives


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_arc_to_warc(version, pack):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\nfiledesc:// 1 2 3 9\n"
    data = warc.arc_version_block(version)
    data += warc.arc_record(version, "http://a/", http, "text/html; charset=x", "19970102030405", "1.2.3.4") + b"\n"
    data += warc.arc_record(version, "dns:a", b"", "text/dns", "1997") + b"\n\n"
    a, b = warc.parse_arc(pack(data))
    assert (a.version, a.block, a.fields["Content-type"]) == (version, http, "text/html; charset=x")
    made = [warc.convert(x) for x in (a, b)]
    assert [m.headers["WARC-Type"] for m in made] == ["response", "resource"]
    assert made[0].headers["WARC-Date"] == "1997-01-02T03:04:05Z" and made[1].headers["WARC-Date"] == "1997-01-01T00:00:00Z"
    assert made[0].headers["WARC-IP-Address"] == "1.2.3.4" and made[0].payload == b"body\n\nfiledesc:// 1 2 3 9\n"
    back = list(warc.parse_warc(pack(b"".join(map(warc.warc_bytes, made)))))
    assert [(r.headers, r.block) for r in back] == [(m.headers | {"Content-Length": str(len(m.block))}, m.block) for m in made]
    assert len({r.headers["WARC-Record-ID"] for r in back}) == 2


def test_cut_arc_is_an_error():
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(warc.arc_version_block(1) + warc.arc_record(1, "http://a/", b"body")[:-1]))


def test_pages_odd_rows(spark):
    html = [None, "", "a", "a", "é\r\n\r\nWARC/1.1\r\n", "a", "x" * 300_000]
    rows = [(10 - i, f"http://h/ {i}\n", h, b"z") for i, h in enumerate(html)] + [(3, None, "twice"), (3, None, "twice"), (None, None, "a"), (None, None, "none")]
    df = spark.createDataFrame([(*r[:3], 1) for r in rows], "page_id long, url string, html string, first int")
    got = warc.archive_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    for r in rows:
        data = (r[2] or "").encode()
        mine = [x for x in got if x.page_id == r[0] and x.payload_digest == warc.sha1_base32(data)]
        assert mine and mine[0].payload_bytes == len(data)
    assert (by[10].record_type, by[10].refers_to, by[9].record_type) == ("revisit", 9, "response")
    assert (by[8].refers_to, by[7].refers_to, by[5].record_type) == (5, 5, "response")
    assert sum(x.page_id == 3 and x.record_type == "response" for x in got) == 2
    assert sorted((x.record_type, x.refers_to) for x in got if x.page_id is None and x.payload_bytes == 1) == [("revisit", 5)]
    big = warc.archive_pages(df, least=2).collect()
    assert {x.record_type for x in big if x.payload_bytes < 2} == {"response"}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archives_are_gzip_files_of_records(spark, data, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{data}/pages.parquet"), path, most=7)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 4 and all(f.name.endswith(".gz") for f in files)
    read = [r for f in files for r in warc.parse_warc(f.read_bytes())]
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    stored = {int(r.headers["WARC-Record-ID"][12:-1]): r.payload.decode() for r in read if r.headers["WARC-Type"] == "response"}
    assert len(read) == len(pages) and all(pages[i] == t for i, t in stored.items())
    assert all(r.headers["WARC-Block-Digest"] == f"sha1:{warc.sha1_base32(r.block)}" for r in read)


# pieces


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(" \n\tab▁<>0x", max_size=40)))
def test_parity_with_sentencepiece(text):
    enc, other = pieces.backend(MODEL)
    text = text.replace("▁", " ") if "▁" in text else text
    ids = enc.encode([text])[0]
    assert ids.tolist() == other.encode(text)
    assert enc.decode(ids) == other.decode(ids.tolist()) or "\x00" in text


def unigram_file(path, spm_kind=1):
    """A small unigram model, written field by field."""

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def message(number, body):
        return varint(number << 3 | 2) + varint(len(body)) + body

    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    vocab += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("ab", -3.5, 1), ("▁a", -3.2, 1), ("▁ab", -4.0, 1), ("ba", -5.0, 1)]
    data = b""
    for p, s, t in vocab:
        data += message(1, message(1, p.encode()) + varint(2 << 3 | 5) + np.float32(s).tobytes() + varint(3 << 3) + varint(t))
    data += message(2, varint(3 << 3) + varint(spm_kind) + varint(35 << 3) + varint(1))
    data += message(3, message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1))
    path.write_bytes(data)
    return str(path)


def test_unigram_with_byte_fallback(tmp_path):
    enc, other = pieces.backend(unigram_file(tmp_path / "u.model"))
    assert enc.model.kind == pieces.UNIGRAM and enc.model.byte_fallback
    for text in ["ab", "abba a", "  ab   ba ", "é ab", "", "aabb", "xyz"]:
        ids = enc.encode([text])[0].tolist()
        assert ids == other.encode(text), text
        assert enc.decode(np.array(ids, dtype=int)) == other.decode(ids)


def test_op4(spark, data):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in queries.op4_sentencepiece(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(rows)
    for d in rows:
        ids = np.array(sp.encode(d.text), dtype="<u4")
        import zlib

        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32, got[d.doc_id].round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
        assert got[d.doc_id].parity in (True, None)
    odd = spark.createDataFrame([(1, None, 0), (None, "", 0), (1, "a " * 50_000, 0)], "doc_id long, text string, ids int")
    assert sorted(r.n_tokens for r in pieces.encode_documents(odd, MODEL).collect())[:2] == [0, 0]
    assert pieces.encode_documents(odd.limit(0), MODEL).count() == 0


def test_parity_of_every_text(spark):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(200)] + [(200, "same")] * 3 + [(201, None)], "doc_id long, text string")
    assert all(r.parity is True for r in pieces.encode_documents(df, MODEL).collect())


def test_ids_that_differ_are_replaced(spark, tmp_path):
    """Of some texts the rebuilt model has other ids than the library."""
    import sentencepiece

    path = unigram_file(tmp_path / "u.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    enc, _ = pieces.backend(path)
    texts = ["ab ba", "a\u2581b", "\u2581 \u2581ab", "a\x00b", "ab\u2581"]
    got = {r.doc_id: r for r in pieces.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == sp.encode(t)
        assert got[i].parity == (enc.encode([t])[0].tolist() == sp.encode(t))
    assert not all(r.parity for r in got.values())


# licences


def test_scan_inherits_from_the_nearest_directory(spark):
    t = license_scan.TEMPLATES
    rows = [
        (1, "r/LICENSE", t["MIT"]), (2, "r/a/COPYING", "x y z\n" + t["GPL-3.0"]), (3, "r/a/b/f.py", "code"), (4, "r/c/f.py", "code\n" + t["Apache-2.0"] + "\nmore"),
        (5, "r/c/g.py", None), (6, "q/f.py", "the license of nothing at all here"), (7, None, t["MIT"]), (8, "ra/f.py", ""), (9, "f.py", t["MIT"] + "\n" + t["Apache-2.0"]), (None, "r/z", "code"),
    ]
    df = spark.createDataFrame([(*r, "n") for r in rows], "file long, path string, text string, licence string")
    got = {r.file: (r.licence, r.found, r.from_dir) for r in license_scan.scan(df).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "own", None), 3: ("GPL-3.0", "inherited", "r/a"), 4: ("Apache-2.0", "own", None), 5: ("MIT", "inherited", "r"),
        6: (None, "none", None), 7: ("MIT", "own", None), 8: (None, "none", None), 9: ("Apache-2.0", "own", None), None: ("MIT", "inherited", "r"),
    }
    assert license_scan.scan(df.limit(0)).count() == 0


def test_scan_compares_headers_and_whole_licence_files(spark):
    full = license_scan.full_texts()
    mit = full["MIT text"].replace("<year> <copyright holders>", "2020 Foo Inc. All rights reserved.")
    rows = [
        ("MIT", "a/LICENSE", mit), ("MIT", "b/f.py", "#!/bin/sh\n" + "".join(f"# {x}\n" for x in mit.split("\n")[2:]) + "code = 1\n" * 500),
        ("BSD-3-Clause", "c/f.c", "/*\n" + full["BSD-3-Clause text"] + "*/\nint main;\n" * 9), ("Apache-2.0", "d/LICENSE", full["Apache-2.0 text"]), ("GPL-3.0", "e/COPYING", full["GPL-3.0 text"]),
        ("MIT", "f/f.c", "MIT License\nx"), ("MIT", "f/g.c", "x\nThe MIT License (MIT)"), ("Proprietary", "g/f.c", "Copyright (c) 2020 Foo Inc. All rights reserved."),
        ("Apache-2.0", "h/f.c", "Copyright 2020 Foo Inc. Licensed under the Apache\n * License, Version 2.0; see there for more"), (None, "i/f.c", "all that was reserved is right\nmit\n" * 50),
        ("MIT", "j/f.c", "x = 1\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the"),
    ]
    df = spark.createDataFrame([(i, path, text) for i, (_, path, text) in enumerate(rows)], "file long, path string, text string")
    got = {r.file: (r.licence, r.found) for r in license_scan.scan(df).collect()}
    assert got == {i: (k, "own" if k else "none") for i, (k, _, _) in enumerate(rows)}


def test_anchors_drop_no_match():
    """No template keeps the threshold without the words of a group of its anchors."""
    for texts, without in ((license_scan.TEMPLATES, set()), (license_scan.NOTICES | license_scan.TITLES | license_scan.full_texts(), license_scan.COMMON)):
        rows, _, _ = license_scan.weights(texts, without)
        for k, groups in license_scan.anchors(rows, 0.8).items():
            assert groups
            for found in groups:
                assert sum(s * s for w, _, t, s in rows if t == k and w not in found) < 0.64


def test_scan_is_native(spark):
    assert license_scan.session_needs_no_python(spark)


@pytest.mark.parametrize("name", ["op1_warc_convert", "op5_license_scan"])
def test_sql_agrees(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, data).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_digest_is_upper_base32():
    assert warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20
