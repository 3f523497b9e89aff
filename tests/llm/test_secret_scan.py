"""Base spans against the plain expressions, the battery against plain sums, random strings against a plain search."""

from __future__ import annotations

import hashlib
import math
import random
import re
import statistics
import string
from collections import defaultdict

import numpy as np
import pytest

from ledgerscope.llm import secret_scan as scan

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m.group(2)) > 5]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) > 19]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) > 23]
    return [s for _, _, s in sorted(out)]


def test_base_spans_same_as_expressions():
    rng = random.Random(5)
    pieces = ["password", "PassWD", "secret", "ToKen", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", "=", ":", "abcdef", "a-b_c.d/e+", "x", "AKIA", "Z9" * 9,
              "0f" * 12, "0f" * 11, "é", "\n", "pass"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 10)))
        assert scan.listed(scan.base_spans(text)) == ",".join(plain_base(text)), text


def plain_fisher(symbols, alphabet):
    """The three p-values from their definitions, one symbol at a time."""
    n, k, x = len(symbols), len(alphabet), [alphabet.index(c) for c in symbols]
    tail = lambda z: max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)
    chi = sum((symbols.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    v = 2 * mean ** 2 / var
    first = tail(((chi / mean) ** (1 / 3) - (1 - 2 / (9 * v))) / math.sqrt(2 / (9 * v)))
    kind = lambda c: "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o"
    if len({kind(c) for c in alphabet}) == 1:
        kind = lambda c: 2 * alphabet.index(c) >= k
    shares = [sum(kind(c) == s for c in alphabet) / k for s in {kind(c) for c in alphabet}]
    q = 1 - sum(s * s for s in shares)
    # chances of two neighbouring changes, over all triples of classes
    both = sum(a * b * c for i, a in enumerate(shares) for j, b in enumerate(shares) for m, c in enumerate(shares) if i != j and j != m)
    spread = math.sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (both - q * q))
    changes = sum(kind(a) != kind(b) for a, b in zip(symbols, symbols[1:]))
    second = min(1.0, 2 * tail(abs(changes - (n - 1) * q) / spread))
    m, s = (k - 1) / 2, statistics.pstdev(range(k))
    third = min(1.0, 2 * tail(abs(sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / s ** 2) / math.sqrt(n - 1)))
    return -2 * (math.log(first) + math.log(second) + math.log(third))


@pytest.mark.parametrize("encoding", list(scan.ALPHABETS))
def test_battery_same_as_definitions(encoding):
    rng, alphabet = random.Random(8), scan.ALPHABETS[encoding]
    for n in (14, 20, 40, 300):
        for text in ("".join(rng.choices(alphabet, k=n)), "".join(rng.choices(alphabet[:5], k=n)), alphabet[0] * n, (alphabet * n)[:n]):
            got = scan.fisher(scan._numbers(text, encoding)[None, :], encoding)[0]
            assert got == pytest.approx(plain_fisher(text, alphabet), rel=1e-9, abs=1e-9)


def test_random_strings_pass_and_patterns_do_not():
    rng = random.Random(2)
    for encoding, alphabet in scan.ALPHABETS.items():
        rows = np.array([scan._numbers("".join(rng.choices(alphabet, k=40)), encoding) for _ in range(400)])
        passed = sum(scan.joint(s) >= scan.ALPHA for s in scan.fisher(rows, encoding))
        assert passed >= 390
        for text in (alphabet[0] * 40, (alphabet * 40)[:40], (alphabet[0] + alphabet[-1]) * 20):
            assert scan.joint(scan.fisher(scan._numbers(text, encoding)[None, :], encoding)[0]) < scan.ALPHA


def test_encodings():
    assert scan.encoding_of("0123456789abcdef01234567")[0] == "hex"
    assert scan.encoding_of("550e8400-e29b-41d4-a716-446655440000") == ("hex", "550e8400e29b41d4a716446655440000")
    assert scan.encoding_of("4467920212765298") is None  # 53 bits
    assert scan.encoding_of("Zm9vYmFyL2Jhei9xdXg+YWJj==")[0] == "base64"
    assert scan.encoding_of("-" * 30) is None
    assert scan.length_class(40) == 32 and scan.length_class(48) == 48 and scan.length_class(64) == 64


def corpus():
    rng = random.Random(11)
    words = ["the", "ordinary", "house", "stood", "near", "River", "and", "nobody", "internationalisationprocesses", "camelCaseIdentifiersEverywhere", "usr/local/share/applications/data"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    keys = string.ascii_letters + string.digits
    docs, planted = [], {}
    for i in range(40):
        docs.append((i, prose(rng.randrange(20, 60))))
    for i in range(100, 130):
        key = "".join(rng.choices(keys, k=40))
        planted[i] = key
        docs.append((i, f"{prose(30)} {key} {prose(10)}"))
    docs += [(200, None), (201, ""), (202, "=" * 50), (203, docs[45][1]), (203, docs[45][1]), (None, docs[46][1]), (204, "token = " + "ab12" * 8),
             (205, "q" * 300_000), (206, prose(20_000) + " " + planted[101]), (207, "".join(rng.choices(keys, k=40)))]
    return docs, planted


def plain_find(docs):
    """Spans of every document by plain loops over all of them."""
    found, tokens = [], {}
    for doc, text in docs:
        text = text or ""
        base = [tuple(s.split(":")) for s in plain_base(text)]
        here = []
        spans = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_-]{14,}=?=?", text)]
        rest = " ".join(text[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)]))
        for a, b in spans:
            if any(int(p) <= a and int(q) >= b for _, p, q in base):
                continue
            kind = scan.encoding_of(text[a:b])
            if kind is None:
                continue
            alphabet = scan.ALPHABETS[kind[0]]
            prose = "".join(c for c in rest if c in alphabet)
            bins = [min(int(plain_fisher(t, alphabet) / scan.BIN), scan.LAST_BIN) for t in [kind[1], *(scan.decoys(prose, len(kind[1])) if prose else [])]]
            group = (kind[0], scan.length_class(len(kind[1])))
            here.append((a, b, group, bins[0]))
            row = (len(bins) == 1, bins[0], bins[1:])
            tokens[text[a:b]] = min(tokens.get(text[a:b], (group, row)), (group, row))
        found.append((doc, base, here))
    limits = {}
    by_group = defaultdict(list)
    for group, (none, own, others) in tokens.values():
        if not none:
            by_group[group].append((own, others))
    for group, rows in by_group.items():
        for most in range(scan.LAST_BIN + 1):
            hits, ordinary = sum(own <= most for own, _ in rows), sum(o <= most for _, others in rows for o in others)
            used = any(own == most or most in others for own, others in rows)
            if used and (1 + ordinary) / (scan.DECOYS * max(1, hits)) <= scan.RATE:
                limits[group] = most
    out = []
    for doc, base, here in found:
        spans = [(int(a), scan.KINDS.index(k), f"{k}:{a}:{b}") for k, a, b in base]
        spans += [(a, 3, f"random:{a}:{b}") for a, b, group, own in here
                  if own <= limits.get(group, -1) and math.exp(-(own + 1) * scan.BIN / 2) * (1 + (own + 1) * scan.BIN / 2 + ((own + 1) * scan.BIN / 2) ** 2 / 2) >= scan.ALPHA]
        out.append((doc, ",".join(":".join(s) for s in base), ",".join(s for _, _, s in sorted(spans))))
    return out


def test_find_same_as_plain_search(spark):
    docs, planted = corpus()
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, `x.y` string, hits int").repartition(3)
    got = sorted(((r["doc_id"], r["base_sha256"], r["spans"]) for r in scan.report(df).collect()), key=repr)
    want = sorted(((d, hashlib.sha256(b.encode()).hexdigest(), s) for d, b, s in plain_find(docs)), key=repr)
    assert got == want
    texts = dict(docs)
    seen = sum(any(texts[d][int(s.split(":")[1]):int(s.split(":")[2])] == key for s in spans.split(",") if s) for d, _, spans in got if d in planted for key in [planted[d]])
    assert seen >= 28
    assert all("random" not in s for d, _, s in got if d is not None and d < 40)


def test_redaction_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a token = abcdefgh1 b", 7), (2, None, 8), (2, None, 8), (None, "AKIA" + "Q" * 20, 9)], "doc_id long, text string, found_spans int")
    got = sorted(((r["doc_id"], r["text"], r["found_spans"]) for r in scan.redact(df).collect()), key=repr)
    assert got == sorted([(1, "a [ASSIGN] b", 7), (2, None, 8), (2, None, 8), (None, "[ACCESS]", 9)], key=repr)


def test_empty_table(spark):
    assert scan.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
