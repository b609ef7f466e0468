import hashlib
import random
import re

import pytest

from heliograph.llm import pii, secrets

PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
SECRETS = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]
HARD = [
    "a@b.c@d.e x@y.zz.q @a.b a.b@-.c mail: x+y%z@h.io.", "1.2.3.4.5 256.1.1.1 1.2.3.999 01.002.3.255 1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112 0000000000000000 79927398713", "+1 (555) 555-0100 +12 +1((((((( +44 20 7946 0958- +1.2.3.4.5.6.7.8.9.0.1.2.3.4.5.6",
    "5" * 5000, "é1.2.3.4😀x@y.zz", "+" * 50 + "1" * 12, "1-2-3 4 5 6 7 8 9 0 1 2 3 4 5 6", "_" * 3000 + "@", "password: hunter22 PASSWD='abc' ToKeN=\"abcdef\" api-key=xxxxxxx apiKEY = zzzzzz9", "AKIAAKIA" + "A" * 8 + " AKIA" + "Z9" * 10, "deadbeef" * 4 + "G" + "0" * 23 + " secret : : xxxxxx ſecret=abcdefgh toKen=abcdefgh",
    "xoxb-1234567890-abc ghp_" + "a1" * 18 + " AIza" + "x" * 35 + " https://user:passw0rd@host/", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "bearer abcdefghijklmnopqrstuvwxyz", "",
]


def luhn(s):
    return sum((lambda x: x - 9 if x > 9 else x)(int(c) * (1 + k % 2)) for k, c in enumerate(s[::-1])) % 10 == 0


def plain_pii(text):
    out = []
    for k, (name, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def plain_secrets(text):
    out = []
    for k, (name, pattern) in enumerate(SECRETS):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m[2] if name == "assign" else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", HARD)
def test_base_pii_of_hard_texts(text):
    assert pii.seeds(text) == plain_pii(text)


def test_base_pii_of_documents(spark, sf, texts):
    for r in pii.op3_pii(spark, sf).collect():
        want = plain_pii(texts[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_patterns_discover_unseen_identifiers(spark):
    known = [(k, f"Reach me: call mobile number +1 555 01{k:02d} {k:04d} please") for k in range(12)]
    unseen = [(100 + k, f"Reach me: call mobile number 020/77{k}88-99{k} please") for k in range(2)]
    noise = [(200 + k, f"In the year of {1000 + k}{k}{k} lines were counted") for k in range(9)]
    df = spark.createDataFrame(known + unseen + noise, "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in pii.find_pii(df, trust=0.8).collect()}
    assert all(len(rows[k].base) == 1 for k, _ in known)
    assert all(not rows[k].base and [x.kind for x in rows[k].spans] == [3] for k, _ in unseen)
    assert all(not rows[k].spans for k, _ in noise)
    strict = pii.find_pii(df, trust=0.999)
    assert all(r.base == r.spans for r in strict.collect())


@pytest.mark.parametrize("unseen", ["020 7946 0958", "(020) 7946 0958", "GB29 NWBK 6016 1331 9268 19", "4111 1111 1111 1112", "7" * 70, "12345 678"])
def test_few_seeds_discover_groups_and_long_tokens(spark, unseen):
    rows = [(k, f"please call mobile {x} today") for k, x in enumerate([*(f"+1 555 0100 {k:03d}" for k in range(5)), unseen])]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    (span,) = found[5].spans
    assert not found[5].base and rows[5][1][span.start : span.end] == unseen and span.kind == 3


def plain_trust(rows, support, trust, rounds):
    """The graph of (instance, kind or None, pattern) by dicts: the trusted patterns with kind and score."""
    kind_of, near = {}, {}
    for instance, kind, pattern in rows:
        near.setdefault(pattern, set()).add(instance)
        if kind is not None:
            kind_of[instance, pattern] = max(kind, kind_of.get((instance, pattern), -1))
    seeds = {}
    for (instance, pattern), kind in kind_of.items():
        seeds[pattern, kind] = seeds.get((pattern, kind), 0) + 1
    seeds = {k: n for k, n in seeds.items() if n >= support}
    score = {(p, k): n / (len(near[p]) + 0.5) for (p, k), n in seeds.items()}
    for _ in range(rounds):
        miss = {}
        for (p, k), v in score.items():
            for i in near[p]:
                if (i, p) not in kind_of:
                    miss[i, k] = miss.get((i, k), 1.0) * (1 - min(v, 0.999))
        score = {(p, k): (n + sum(1 - miss[i, k] for i in near[p] if (i, p) not in kind_of)) / (len(near[p]) + 0.5) for (p, k), n in seeds.items()}
    best = {}
    for (p, k), v in score.items():
        if v >= trust:
            best[p] = max(best.get(p, (0, 0)), (v, k))
    return best


def test_graph_scores_and_planted_identifiers(spark):
    """Scores against a plain version; of planted identifiers all at patterns with seeds are found, and no other number."""
    rng = random.Random(11)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows, planted = [], {}
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    for k in range(240):
        kind = k % 4
        cue = ("mail me at", "server address", "card number", "ring me on")[kind]
        own = (f"{filler(1)}{k}@x.example.com", f"10.{k % 256}.3.{k % 200}", "4111111111111111 " if k == 2 else f"4539 1488 0343 {6400 + k}", f"+1 (555) 010-{1000 + k}")[kind]
        if kind != 2 or k == 2:
            rows.append((k, f"{filler(6)} {cue} {own.strip()} {filler(5)}"))
    for k in range(300, 330):
        hidden = rng.choice([digits(9), f"0{digits(2)} {digits(4)} {digits(4)}"])
        rows.append((k, f"{filler(6)} ring me on {hidden} {filler(5)}"))
        planted[k] = hidden
    rows += [(k, f"{filler(6)} order {digits(9)} of {filler(5)}") for k in range(400, 430)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    edges = [(text[s:e].lower(), k, p) for _, text in rows for found in [pii.seeds(text)] for words in [[m.span() for m in re.finditer(r"\S+", text)]]
             for s, k, e in [*found, *((s, None, e) for s, e in pii._unseen(text, found))] for p in pii._patterns(text, s, e, words, [s for s, _ in words])]
    want = plain_trust(edges, pii.SUPPORT, 0.5, pii.ROUNDS)
    got = {r.pattern: (r.score, r.kind) for r in pii.trusted_patterns(spark.createDataFrame(edges, "instance string, kind int, pattern string"), trust=0.5).collect()}
    assert got.keys() == want.keys() and "before me on" in got and all(abs(got[p][0] - v) < 1e-9 and got[p][1] == k for p, (v, k) in want.items())
    texts = dict(rows)
    found = {r.doc_id: [texts[r.doc_id][x.start : x.end] for x in r.spans if x not in r.base] for r in pii.find_pii(df).collect()}
    assert {i: x for i, x in found.items() if x} == {i: [x] for i, x in planted.items()}


def test_pii_of_hostile_rows(hostile, none):
    rows = pii.find_pii(hostile).collect()
    assert len(rows) == hostile.count()
    assert [(x.kind, x.start, x.end) for r in rows if r.doc_id == -4 for x in r.base] == [(0, 0, 6), (1, 7, 14), (3, 15, 32)]
    assert all(not r.spans for r in rows if r.doc_id in (1, 2, 5, 10))
    assert pii.find_pii(none).count() == 0


@pytest.mark.parametrize("text", HARD)
def test_secrets_of_hard_texts(text):
    scanner = secrets.Scanner()
    found = scanner.scan([text, "", text])
    assert found[0] == found[2] and not found[1]
    assert [x for x in found[0] if x[1] < 3] == plain_secrets(text)
    full = sorted((m.start(), k, m.end()) for k, rule, regex, _ in scanner.rules for m in regex.finditer(text) if not rule.least or len(m[rule.group]) >= rule.least)
    assert found[0] == full  # the index loses nothing


def test_trigram_queries():
    q = secrets.trigram_query
    assert q(r"[0-9a-f]{24,}") is secrets.ALL and q("ab") is secrets.ALL and q("a.*b") is secrets.ALL
    assert q("AKIA[A-Z]+") == ("and", ("aki", "kia"))
    assert q("(abc|xyz)d") == ("or", (("and", ("abc", "bcd")), ("and", ("xyz", "yzd"))))
    assert q("abc?d") is secrets.ALL or q("abc?d")[0] == "or"
    assert q("(?:abc)?") is secrets.ALL and q("a{3}") is secrets.ALL


def test_postings_of_a_segment(monkeypatch):
    monkeypatch.setattr(secrets.Index, "STEP", 7)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abC\u00e9\u00c9 k", k=rng.randrange(40))) for _ in range(60)] + [""]
    grams = {"abc", "bca", "a k", "kkk", "zzz"}
    index = secrets.Index([x.encode() for x in texts], grams)
    fold = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    for g in grams:
        assert index.candidates(g).tolist() == [k for k, x in enumerate(texts) if g in fold(x)]
    both = index.candidates(("and", ("abc", ("or", ("bca", "zzz")))))
    assert both.tolist() == [k for k, x in enumerate(texts) if "abc" in fold(x) and "bca" in fold(x)]
    assert index.candidates(secrets.ALL).tolist() == list(range(61)) and len(secrets.Index([], grams).candidates("abc")) == 0


def test_passwords_in_addresses_of_any_length():
    scanner = secrets.Scanner()
    long = "u" * 500
    for text in (f"see https://{long}:{'p' * 900}@host", "ftp://me:secret1@h", "a" * 100_000 + "://x", "x://" * 20_000):
        want = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9+.-]+://[^\s:/@\"'<>]+:[^\s:/@\"'<>]{6,}@", text[:2000])]
        assert [(s, e) for s, k, e in scanner.scan([text])[0] if secrets.RULES[k].kind == "url"] == want


def test_base_secrets_of_documents(spark, sf, texts):
    for r in secrets.op8_secret_scan(spark, sf).collect():
        want = plain_secrets(texts[r.doc_id])
        line = ",".join(f"{SECRETS[k][0]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_secrets_of_hostile_rows(hostile, none):
    assert secrets.find_secrets(hostile).count() == hostile.count() and secrets.find_secrets(none).count() == 0
    clean = secrets.redact(hostile)
    assert clean.columns == hostile.columns and clean.count() == hostile.count()
    row = clean.where("doc_id IS NULL").first()
    assert row.text == "a text without an id, with [SECRET]" + '"' and row.n_chars == len(row.text)
    before, after = ({(r.doc_id, r.text) for r in x.where("doc_id <> -4").collect()} for x in (hostile, clean))
    assert before == after
    assert secrets.redact(none).count() == 0
    assert all(not r.spans for r in secrets.find_secrets(clean).collect() if r.doc_id is None)
