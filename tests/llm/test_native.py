"""The operators in DataFrame functions against plain Python: sharding, URL filters, secrets."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

from pyspark.sql import functions as F

from starloom.llm import secrets, sharding, urls

from .hard_texts import HARD_TEXTS


def test_feistel_is_a_permutation(spark):
    for rows in (1, 2, 3, 7, 24, 100, 1000, 4097):
        images = [r[0] for r in spark.range(rows).select(sharding.feistel(F.col("id"), rows, 5)).collect()]
        assert sorted(images) == list(range(rows))
        if rows >= 100:
            assert sum(a == i for i, a in enumerate(images)) < rows / 10


def test_shards(documents):
    texts = HARD_TEXTS + [f"text {i}" for i in range(90)] + ["same"] * 40
    frame = documents(texts).union(documents(["again", None]))
    rows = sharding.shard_documents(frame, 24, seed=3).collect()
    assert len(rows) == len(texts) + 2
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in [*enumerate(texts), (0, "again"), (1, None)])
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    again = sharding.shard_documents(frame.repartition(7), 24, seed=3).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in again) == Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows)
    assert sharding.shard_documents(documents([]), 24).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/es", "allow")]
URLS = [
    None, "", "no address", "http://example.com/en/x", "HTTP://WWW.Example.COM/en/", "http://www.example.com", "http://www.example.com/", "https://a.b.net/es/1?q=/x", "https://a.net/es/1",
    "https://a.net/esx", "http://notexample.com/en/", "http://xcom/en/", "//x.com/y", "http:///en/", "a://b://c.com/", "http://é.com/en/\nz", "http://example.com/en/x", "http://x.com?/en/", "http://com/",
]


def judged(url):
    m = re.search(r"^.*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in RULES if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_long_urls_and_many_path_lengths(spark, make, monkeypatch):
    long = "http://" + "a." * 300_000 + "example.com/en/" + "x" * 400_000
    started = time.time()
    frame = make([(0, long), (1, "http://b.net/es/1"), (2, None)], "page_id long, url string")
    want = [("example.com/en/", "block"), ("net/es/", "block"), (None, "allow")]
    for most in (256, 2):  # lengths as constants and as a table
        monkeypatch.setattr(urls, "MOST_LENGTHS", most)
        rows = sorted(urls.judge_urls(frame.where("page_id > 0") if most == 2 else frame, urls.rule_table(spark, RULES + [("q.com", "/" + "y" * n, "block") for n in range(5)])).collect(), key=lambda r: r.page_id)
        assert [(r.rule, r.verdict) for r in rows] == want[-len(rows) :]
    assert time.time() - started < 60


def test_url_rules(spark, make):
    frame = make([(i, u, "mine") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    rows = urls.judge_urls(frame, urls.rule_table(spark, RULES)).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == judged(URLS[r.page_id]), r
    shuffled = urls.judge_urls(frame, urls.rule_table(spark, RULES), prefix_digits=1)  # many prefixes collide; digests decide
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, rows))
    none = urls.judge_urls(frame, urls.rule_table(spark, []), default="block").collect()
    assert {r.verdict for r in none} == {"block"}
    assert urls.judge_urls(make([], "page_id long, url string"), urls.rule_table(spark, RULES)).count() == 0


def test_url_rules_by_shuffle(spark, make, monkeypatch):
    frame = make([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    want = sorted(map(str, urls.judge_urls(frame, urls.rule_table(spark, RULES)).collect()))
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert sorted(map(str, urls.judge_urls(frame, urls.rule_table(spark, RULES)).collect())) == want


def brute_spans(text):
    """All spans of a text, by Python's re."""
    found = {}
    for kind, pattern, group, least, most in (
        ("assign", secrets.ASSIGN, 2, 6, 1 << 30), ("access", secrets.ACCESS, 0, 20, 1 << 30), ("hex", "[0-9a-f]+", 0, 24, 1 << 30),
        ("client", secrets.CLIENT, 2, 3, 1 << 30), ("key", secrets.KEY, 0, 40, 40), ("endpoint", secrets.ENDPOINT, 0, 1, 1 << 30),
    ):
        found[kind] = [m.span() for m in re.finditer(pattern, text, re.A) if least <= len(m[group]) <= most]
    near = lambda kinds, x: any(s < x[1] + secrets.SCOPE and e > x[0] - secrets.SCOPE for k in kinds for s, e in found[k])
    apart = lambda x: not any(s < x[1] and e > x[0] for k in ("assign", "access", "hex") for s, e in found[k])
    base = [(s, secrets.KINDS.index(k), k, e) for k in ("assign", "access", "hex") for s, e in found[k]]
    identifier, secret = ("access", "client"), ("assign", "hex", "key")
    more = [(x[0], 3, "client", x[1]) for x in found["client"] if apart(x) and near(secret, x) and near(["endpoint"], x)]
    more += [(x[0], 4, "key", x[1]) for x in found["key"] if apart(x) and near(identifier, x)]
    more += [(x[0], 5, "endpoint", x[1]) for x in found["endpoint"] if apart(x) and near(identifier, x) and near(secret, x)]
    name = lambda spans: ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
    return name(base), name(base + more)


def secret_texts():
    rng = random.Random(8)
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    parts = ["AKIA" + "B2" * 8, "AKIA123", "AKIAAKIA" + "X" * 12, key, key + "x", "password=hunter2x", "token: 'abc'", "token=token: abcdefgh", 'API_KEY = "Zz9-_./+="', "é" * 20, "x " * 60, "ab12" * 6, "0" * 23,
             "client_id=me42", "user: bob", "https://db.example.org/x?y", "s3://bucket/path", "😀", "\n", "secret==", "passwd:  longvalue1"]
    out = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    return out + ["".join(rng.choice(parts) for _ in range(6)) for _ in range(200)] + HARD_TEXTS + [" ".join(["password=abcdef1", key, "AKIA" + "C" * 16] * 150)]


def test_secret_spans(documents):
    texts = secret_texts()
    frame = documents(texts)
    rows = {r.doc_id: r for r in secrets.secret_report(frame).collect()}
    for i, text in enumerate(texts):
        base, spans = brute_spans(text or "")
        assert rows[i].spans == spans, (text, rows[i].spans, spans)
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert rows[i].n_assign == base.count("assign") and rows[i].n_access == base.count("access") and rows[i].n_hex == base.count("hex")


def test_lone_key_is_not_reported(documents):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    spans = [r.spans for r in secrets.secret_report(documents([key, key + " AKIA" + "Z" * 16, key + " " * 300 + "AKIA" + "Z" * 16])).orderBy("doc_id").collect()]
    assert [("key" in s) for s in spans] == [False, True, False]


def test_redaction(documents, make):
    texts = secret_texts()
    rows = {r.doc_id: r for r in secrets.redact_secrets(documents(texts)).collect()}
    for i, text in enumerate(texts):
        spans = [s.split(":") for s in brute_spans(text or "")[1].split(",") if s]
        want, at = "", 0
        for kind, start, end in spans:
            if int(start) >= at:
                want += text[at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        want = want + text[at:] if spans else text
        assert rows[i].text == want and rows[i].n_chars == (None if text is None else len(want))
    frame = make([(1, "token=abcdefgh", 5, "x")], "doc_id long, text string, secret_base long, __parts string")
    assert secrets.redact_secrets(frame).columns == frame.columns
    assert secrets.redact_secrets(documents([])).count() == 0
