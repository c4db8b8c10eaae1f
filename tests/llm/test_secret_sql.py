"""The SQL of the secret scan against the operator, on texts with every kind of secret."""

import random

from rasterloom.llm import queries, secrets
from tests.llm.test_operators import SECRETS


def test_sql_gives_the_operators_spans(spark):
    import duckdb

    luck = random.Random(11)
    body = lambda n: "".join(luck.choice(secrets.DIGITS) for _ in range(n))
    token = lambda: (b := body(30)) and f"{luck.choice(['ghp_', 'npm_', 'ghs_'])}{b}{secrets.checksum(b)}"
    web = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----"
    parts = [token, lambda: f"{token()}x", lambda: f"ghp_{body(36)}", lambda: f"npm_ab{token()}", lambda: f"ghp_{body(33)}{token()}", lambda: web, lambda: web[:20], lambda: key, lambda: key[:30], lambda: "token=" + body(8), lambda: "é ü", lambda: "AKIA" + "A1" * 9, lambda: "0a" * 13, lambda: " ", lambda: "secret: " + web]
    texts = SECRETS + [None, ""] + ["".join(luck.choice(parts)() + luck.choice(["", " ", ".", "é"]) for _ in range(luck.randrange(12))) for _ in range(400)]
    rows = [*enumerate(texts)] + [(5, texts[5]), (None, "token=abcdefgh")]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(queries.ORACLE_SQL["op10_secrets"])
    names = [c[0] for c in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    kinds = {s.split(":")[0] for r in got.collect() for s in r["spans"].split(",") if s}
    assert kinds == {*secrets.BASE, *secrets.MORE}
