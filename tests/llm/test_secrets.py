import random
import re

from millrace.llm import secrets as X

RE = {
    "assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(RE.items()):
        for m in re.finditer(pattern, text or ""):
            if {"assign": lambda: len(m.group(2)) >= 6, "access": lambda: len(m.group()) >= 20, "hex": lambda: len(m.group()) >= 24}[kind]():
                out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def texts():
    r = random.Random(12)
    bits = ["password=abc123x", 'Token : "deadbeef00"', "PASSWD:x", "api_key='A-b_c.d==", "apikey = = =", "secret", " ", "=", ":", "AKIA" + "A1" * 8, "AKIAZZ", "0123456789abcdef" * 2, "dead", "é😀", "x",
            "user=bob7", "pwd: hunter2", "https://db.example.org:8443/x", "host.local:5432", "Zm9vYmFyMTIzNDU2Nzg5MEFCQ0RFRkdISUpLTE1O", "\n", "token='"]
    out = ["".join(r.choice(bits) for _ in range(r.choice([1, 3, 10, 50]))) for _ in range(150)]
    return [*out, None, "", "a" * 30_000, "token" + " " * 20_000, "AKIA" * 5000, "k" * 30_000 + "=", "password=123456 " * 2000]


def test_base_against_brute_force(spark):
    rows = [(i // 2, t, "x", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, start int").repartition(3)
    got = X.summarise(X.find(df)).collect()
    want = []
    for i, t, *_ in rows:
        b = brute(t)
        want.append((i, ",".join(f"{k}:{s}:{e}" for k, s, e in b), *[sum(x[0] == k for x in b) for k in RE]))
    assert sorted((r.doc_id, r.base, r.n_assign, r.n_access, r.n_hex) for r in got) == sorted(want)
    assert all(set(r.base.split(",")) <= {"", *r.spans.split(",")} for r in got)


def test_weak_parts_need_their_complements(spark):
    rows = [
        (1, "the user=bob7 logs in"), (2, "pwd: hunter2 only"), (3, "see https://db.example.org:8443/x for more"), (4, "user=bob7 pwd: hunter2"),
        (5, "user=bob7 pwd: hunter2 at https://db.example.org/x"), (6, "user=bob7 " + "far " * 60 + "pwd: hunter2"), (7, "AKIA" + "A1" * 8 + " pwd: hunter2"),
    ]
    got = {r.doc_id: r.spans for r in X.summarise(X.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1] == got[2] == got[3] == got[6] == ""
    assert got[4] == "identifier:0:9,weak_secret:10:22"
    assert got[5] == "identifier:0:9,weak_secret:10:22,endpoint:26:50"
    assert got[7] == "access:0:20,weak_secret:21:33"


def test_empty(spark):
    assert X.summarise(X.find(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_scope_is_around_the_span_and_lengths_are_open(spark):
    jwt, path = "eyJh" + "aB3d" * 150, "x" * 600
    opaque = "Zm9vYmFy" * 40 + "A1"
    rows = [
        (1, f"token: {jwt}\nuser=bob7"), (2, f"https://a.org/{path} user=bob7 pwd: hunter2"), (3, f"pwd: {path}\nuser=bob7"), (4, f"user=bob7 {opaque}"),
        (5, f"token: {jwt} " + "far " * 60 + "user=bob7"), (6, "user=" + "z" * 200 + " pwd: hunter2"), (7, f"user=bob7 {'q' * 100}{opaque}"), (8, f"user=bob7 {path} pwd: hunter2"),
    ]
    got = {r.doc_id: r.spans for r in X.summarise(X.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1] == f"assign:0:{7 + len(jwt)},identifier:{8 + len(jwt)}:{17 + len(jwt)}"
    assert got[2] == "endpoint:0:614,identifier:615:624,weak_secret:625:637"
    assert got[3] == "weak_secret:0:605,identifier:606:615"
    assert got[4] == f"identifier:0:9,opaque:10:{10 + len(opaque)}"
    assert "identifier" not in got[5] and got[8] == ""
    assert got[6] == "identifier:0:205,weak_secret:206:218"
    assert got[7] == f"identifier:0:9,opaque:10:{110 + len(opaque)}"


def test_a_part_is_not_its_own_complement(spark):
    token = "aB3dEf6hIj9kLm2nOp5qRs8tUv1wXy4zAb7c"
    rows = [
        (1, f"client_id: {token} only an id"), (2, f"wss://h.{token}"), (3, f"auth: {token} alone"), (4, f"client_id: {token} pwd: hunter2"), (5, f"wss://h.{token} user=bob7 pwd: hunter2"),
        (6, f"wss://h.{token} user=bob7"), (7, f"{token} user=bob7 user=bob8"), (8, "user=bob7 " * 3),
    ]
    got = {r.doc_id: r.spans for r in X.summarise(X.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1] == got[2] == got[3] == got[6] == got[8] == ""
    assert got[4] == "identifier:0:47,weak_secret:48:60" and got[5] == "endpoint:0:44,identifier:45:54,weak_secret:55:67"
    assert got[7] == "opaque:0:36,identifier:37:46,identifier:47:56"


def linked(parts, scope=160):
    """By brute force over all pairs; parts: (kind, start, end)."""
    of = {"ids": ["identifier", "access"], "secrets": ["weak_secret", "assign", "hex"], "opaques": ["opaque"], "ends": ["endpoint"]}
    base = [p for p in parts if p[0] in X.BASE]
    weak = [p for p in parts if p[0] not in X.BASE and all(p[2] <= b[1] or b[2] <= p[1] for b in base)]
    before = lambda q, p: (q[1], -q[2], X.KINDS.index(q[0])) < (p[1], -p[2], X.KINDS.index(p[0]))
    weak = [p for p in weak if not any(before(q, p) and q[2] >= p[2] for q in weak)]
    out = list(base)
    for p in weak:
        near = lambda x: any(q[0] in of[x] and (q[2] <= p[1] <= q[2] + scope or p[2] <= q[1] <= p[2] + scope) for q in base + weak)  # noqa: B023, E731
        ok = {
            "identifier": near("secrets") or near("opaques"), "weak_secret": near("ids"), "opaque": near("ids") or near("ends"),
            "endpoint": near("ids") and (near("secrets") or near("opaques")),
        }[p[0]]
        out += [p] if ok else []
    return sorted(out, key=lambda p: (p[1], X.KINDS.index(p[0])))


def test_linking_against_brute_force(spark):
    from millrace.llm import spans as S
    from pyspark.sql import functions as F

    r = random.Random(8)
    bits = ["user=bob7", "pwd: hunter2", "wss://h.example.org/x", "db.local:5432", "aB3dEf6hIj9kLm2nOp5qRs8tUv1wXy4z", "token=abcdef1", "AKIA" + "A1" * 8, "client_id: aB3dEf6hIj9kLm2nOp5qRs8tUv1wXy4z", "far " * 30, "x " * 20, "\n"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(1, 14)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    parts = {}
    for x in S.located(df, X._patterns(F.col("text")), context=0).where("kind is not null").where(X._valid()).collect():
        parts.setdefault(x.doc_id, []).append((x.kind, x.start, x.end))
    got = {x.doc_id: x.spans for x in X.summarise(X.find(df)).collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in linked(parts.get(i, []))) for i, _ in rows}
