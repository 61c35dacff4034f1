import pytest

from lakeatlas.llm.license_scan import TEMPLATES, anchors_of, n_bands, scan_licenses, shingles_of, siblings_of, step, window_lengths, words_of

KNOWN = [(i, n, words_of(t)) for i, (n, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]


def brute(text):
    """All windows of all templates, without bands, anchors or hashes."""
    words = words_of(text or "")
    group, cut = siblings_of(KNOWN), window_lengths(KNOWN)
    have = shingles_of(words)
    out = {}
    likely = [(i, n, shingles_of(w)) for i, n, w in KNOWN if len(shingles_of(w) & have) >= 0.8 * len(shingles_of(w))]
    for c in {cut[i] for i, _, _ in likely}:
        found = []
        for s in range(0, max(len(words) - c - step(c), 0) + step(c), step(c)):
            window = shingles_of(words[s : s + c + step(c)])
            found += [(s // step(c), group[i], n, len(own & window) / len(own)) for i, n, own in likely if cut[i] == c]
        for s, g, n, share in found:
            if share >= 0.8 and share == max(x for t, h, _, x in found if h == g and abs(s - t) <= 2):
                out[n] = max(share, out.get(n, 0))
    return {n: x for n, x in out.items() if not (n == "BSD-2-Clause" and "BSD-3-Clause" in out)}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {}
    for r in scan_licenses(docs).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    want = {r.doc_id: w for r in docs.collect() if (w := brute(r.text))}
    assert got == want and len(want) > 100


def test_changed_and_long_notices(spark):
    texts = []
    for name, ts in TEMPLATES.items():
        for t in ts:
            w = t.split()
            texts += [(name, "before it " * 40 + t + " after " * 40), (name, t.upper())]
            if len(w) > 20:
                texts += [(name, " ".join(x for i, x in enumerate(w) if i != len(w) // 2)), (None, " ".join(x for i, x in enumerate(w) if i % 3))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in scan_licenses(df).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, (name, t) in enumerate(texts):
        whole = name and any(x.upper() in t.upper() for x in TEMPLATES[name])
        assert got.get(i, set()) == set(brute(t)) and (name is None or name in got[i]) and (not whole or got[i] == {name})


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "all rights"), (4, "All rights reserved."), (4, "All rights reserved"), (None, "ALL RIGHTS\nRESERVED"), (5, "word " * 200_000 + "released under the mit license"), (6, "reserved rights all")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, length int")
    assert sorted((str(r.doc_id), r.license) for r in scan_licenses(df).collect()) == [("4", "Proprietary"), ("5", "MIT"), ("None", "Proprietary")]
    assert scan_licenses(df.limit(0)).count() == 0


def test_anchors_and_bands():
    for ts in TEMPLATES.values():
        for t in ts:
            w = words_of(t)
            s, a = shingles_of(w), anchors_of(w, 0.8)
            with_anchor = sum(any(x in y for x in a) for y in s)
            assert len(s) - with_anchor < 0.8 * len(s)
    assert 1 - (1 - 0.8 / 1.4) ** n_bands([(20, 20)], 0.8, 0.9999) > 0.9999
    cut = window_lengths(KNOWN)
    assert all(len(w) <= cut[i] for i, _, w in KNOWN) and len(set(cut.values())) < len({len(w) for _, _, w in KNOWN})


NOTICE = "This program is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. "


@pytest.mark.parametrize("license, version, found", [("GNU General Public License", "2", "GPL-2.0"), ("GNU General Public License", "3", "GPL-3.0"), ("GNU Lesser General Public License", "2.1", "LGPL-2.1"), ("GNU Lesser General Public License", "3", "LGPL-3.0"), ("GNU Affero General Public License", "3", "AGPL-3.0")])
def test_siblings_are_told_apart(spark, license, version, found):
    texts = [(k, "some words before " * k + NOTICE.format(license, version) + "and others after it " * 20) for k in range(25)]
    both = [(100, texts[0][1] + "word " * 99 + NOTICE.format("GNU General Public License", "2"))]
    bsd = [(200, " ".join(TEMPLATES["BSD-2-Clause"])), (201, " ".join(TEMPLATES["BSD-2-Clause"] + TEMPLATES["BSD-3-Clause"]))]
    got = {}
    for r in scan_licenses(spark.createDataFrame(texts + both + bsd, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert all(got[k] == {found} for k, _ in texts) and got[100] == {found, "GPL-2.0"}
    assert got[200] == {"BSD-2-Clause"} and got[201] == {"BSD-3-Clause"}
