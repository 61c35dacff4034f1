import hashlib
import re

from pyspark.sql import functions as F

from lakeatlas.llm import registry, secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    t = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def compare(df, rows):
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans if s["no"] < 3]) for r in df.collect()), key=str)
    assert got == sorted(((d, brute(t)) for d, t in rows), key=str)


def test_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    compare(secret_scan.scan_secrets(documents), rows)
    got = registry.QUERIES["op10_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    texts = dict(rows)
    for r in got:
        spans = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == digest(spans)
    assert sum(r.n_assign for r in got) > 0


def test_edges(spark):
    texts = [
        None, "", "token", "token=abc", "token=abcdef", "é😀 Token : 'ABCdef12' x", "secret=token:abcdefg", "password password=xx secret=abcdefgh",
        "PASSWD\"= \"a+/_.=-", "api_key=abcdef apikey=abcdef API_KEY:abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B2" * 9 + "z", "f" * 23 + " " + "0" * 24,
        "\x01token=abcdefgh\x02" + "a1" * 20, "token=" + "ab12" * 10, "tokeN = abcdef\ntoken=\nabcdef", "$0 \\1 token=abc$def1", "passſwd=abcdef toKen=abcdef",
        ("token=abcdef " * 3000) + "\n" + "x" * 100_000,
    ]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts + texts[4:8])]
    df = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, blob string, spans int")
    compare(secret_scan.scan_secrets(df), rows)
    assert secret_scan.scan_secrets(df.limit(0)).count() == 0
    more = spark.createDataFrame([(1, "ghp_" + "Z9" * 18 + " -----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string")
    assert [s.kind for s in secret_scan.scan_secrets(more).first().spans] == ["github", "pem"]


def test_ledger_scans_only_what_it_has_not_seen(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    old = spark.createDataFrame([(1, "token=abcdef"), (2, "nothing")], "doc_id long, text string")
    ledger = secret_scan.update_ledger(old, path)
    assert ledger.count() == 2 == secret_scan.update_ledger(old, path).count()
    # a forged entry shows that the stored findings are used and the blob isn't scanned again
    forged = ledger.withColumn("spans", F.expr("transform(spans, s -> named_struct('start', s.start + 100, 'no', s.no, 'end', s.end, 'kind', s.kind))"))
    forged.write.parquet(f"{path}-forged")
    new = spark.createDataFrame([(3, "token=abcdef"), (4, "nothing"), (5, "AKIA" + "A" * 16)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(new, f"{path}-forged").collect()}
    assert got[3][0].start == 100 and got[4] == [] and got[5][0].kind == "access"
    assert spark.read.parquet(f"{path}-forged").count() == 3
    assert [r.blob for r in secret_scan.unseen_blobs(new, ledger).collect()] == [hashlib.sha256(("AKIA" + "A" * 16).encode()).hexdigest()]
    assert secret_scan.update_ledger(old, path, version="next").count() == 4
    assert len(secret_scan.scan_secrets(old, path, version="next").collect()) == 2


def test_many_paths_and_many_secrets(spark):
    text = "x token=abcdef " * 2000
    df = spark.createDataFrame([(i, text) for i in range(300)] + [(2**53 + 1, None), (None, "y")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: len(r.spans) for r in secret_scan.scan_secrets(df).collect()}
    assert len(got) == 302 and got[2**53 + 1] == 0 and {got[i] for i in range(300)} == {2000}
    masked = {r.text for r in secret_scan.redact_secrets(df).collect()}
    assert masked == {"x [SECRET] " * 2000, None, "y"}


def test_redaction(spark):
    rows = [(1, "a token=abcdef b", 16, 7), (2, None, None, 7), (3, "clean", 99, 7), (3, "é😀 token=" + "ab12" * 10 + "!", 50, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, blob int")
    got = sorted(map(tuple, secret_scan.redact_secrets(df).collect()), key=str)
    assert got == sorted([(1, "a [SECRET] b", 12, 7), (2, None, None, 7), (3, "clean", 99, 7), (3, "é😀 [SECRET]!", 12, 7)], key=str)
