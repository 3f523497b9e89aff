"""Base spans against the plain expressions, revealing terms against plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from ledgerscope.llm import disclosure

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        odd = sum(map(int, d[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
        if 13 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_same_as_expressions():
    rng = random.Random(3)
    pieces = ["a@b.co", "@", "x.y+z%@h-1.example.org", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+49 (30) 123-4567", "+1", "+", "é", " ", "\n", "12345678901234567890", "a@b", "a@b.", "x@y.z@w.v.u", "0" * 30, "-", "5500005555555559", "(", "..", "00.001.2.3"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))
        assert disclosure.base_spans(text) == plain_base(text), text


def test_long_runs_are_fast():
    for text in ("a" * 200_000, "a." * 100_000 + "@", "1" * 200_000, "1." * 100_000, "0" * 6000 + "1.2.3.4 " + "9" * 6000 + ".1.2.3", "+1" * 100_000, "@" * 100_000, "1 " * 100_000):
        assert isinstance(disclosure.base_spans(text), list)


def corpus():
    rng = random.Random(6)
    filler = ["red", "blue", "green", "house", "tree", "river", "stone"]
    prose = lambda n: " ".join(rng.choices(filler, k=n))
    docs = []
    for i in range(60):
        docs.append((i, prose(rng.randrange(3, 30))))
    for i in range(8):
        docs.append((100 + i, f"{prose(9)} call Zanzibarov now ann@x.org {prose(9)}"))
        docs.append((200 + i, f"{prose(3)} call me +49 30 1234567{i} {prose(4)}"))
    docs += [(300, None), (301, ""), (302, "é ann@x.org"), (302, "é ann@x.org"), (None, "bob@y.de zzz"), (303, "same zzz copy carl@q.fr"), (304, "same zzz copy carl@q.fr"),
             (305, "same zzz copy carl@q.fr"), (306, "same zzz copy carl@q.fr"), (307, "w " * 50_000 + "ann@x.org")]
    return docs


def plain_terms(docs):
    n, n_t, n_e, together, around = len(docs), Counter(), Counter(), defaultdict(set), defaultdict(set)
    per_doc = []
    for row, (_, text) in enumerate(docs):
        text = text or ""
        n_t.update({m.lower() for m in re.findall(r"[^\W\d_]{2,}", text)})
        spans, found = plain_base(text), []
        n_e.update({(k, text[a:b].lower()) for k, a, b in spans})
        for k, a, b in spans:
            left = [m for m in re.finditer(r"[^\W\d_]{2,}", text) if m.end() <= a and m.start() >= a - 24 * disclosure.REACH][-disclosure.REACH:]
            right = [m for m in re.finditer(r"[^\W\d_]{2,}", text) if m.start() >= b][:disclosure.REACH]
            near = [m for m in left + right if not any(m.start() < y and x < m.end() for _, x, y in spans)]
            context = " ".join(m.group().lower() for m in near)
            for m in near:
                key = ((k, text[a:b].lower()), m.group().lower())
                together[key].add(row)
                around[key].add(context)
                found.append((key, m.span()))
        per_doc.append((listed_base(spans), found))
    out = []
    for (doc, _), (base, found) in zip(docs, per_doc):
        hits = set()
        for (entity, term), span in found:
            own = math.log2(n / n_e[entity])
            share = math.log2(len(together[entity, term]) * n / (n_t[term] * n_e[entity])) / own
            if len(around[entity, term]) >= disclosure.SUPPORT and share >= disclosure.GENERALISE:
                hits.add(span)
        out.append((doc, ",".join(filter(None, [base, *(f"term:{a}:{b}" for a, b in sorted(hits))]))))
    return out


def listed_base(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_report_same_as_plain(spark):
    docs = corpus()
    rows = disclosure.report(spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, hits string")).collect()
    want = plain_terms(docs)
    assert sorted(str((r["doc_id"], r["spans"])) for r in rows) == sorted(map(str, want))
    assert sum("term:" in s for _, s in want) >= 8
    digests = {(i, hashlib.sha256(listed_base(plain_base(t or "")).encode()).hexdigest()) for i, t in docs}
    assert {(r["doc_id"], r["base_sha256"]) for r in rows} == digests


def test_sanitise_and_empty_table(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, found_base int")
    rows = {r["doc_id"]: r["text"] for r in disclosure.sanitise(frame).collect()}
    assert len(rows) == len({i for i, _ in docs}) and rows[300] is None and rows[301] == ""
    assert "[EMAIL]" in rows[100] and "Zanzibarov" not in rows[100] and "ann@x.org" not in rows[100]
    assert rows[0] == docs[0][1]
    assert disclosure.report(frame.limit(0)).count() == 0


def test_pairs_seen_once_or_twice_are_judged(spark):
    rng = random.Random(8)
    filler = ["red", "blue", "green", "house", "tree", "river", "stone"]
    prose = lambda n: " ".join(rng.choices(filler, k=n))
    docs = [(i, prose(20)) for i in range(800)]
    docs += [(900, f"{prose(5)} Quillon dan@x.org {prose(6)}"), (901, f"{prose(7)} Quillon dan@x.org {prose(8)}"), (902, f"{prose(5)} Orlop eve@x.org {prose(6)}")]
    rows = {r["doc_id"]: r["text"] for r in disclosure.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all("[NAME] [EMAIL]" in rows[i] for i in (900, 901, 902))
    assert all(rows[i].count("[") == 2 for i in (900, 901, 902)) and all(rows[i] == t for i, t in docs[:800])


def test_six_terms_at_any_distance():
    text = " ".join(["Zed", "x" * 200, "one", "12 " * 300, "two", "three", "four", "ann@x.org", "y" * 400, "five"])
    (_, _, found), = disclosure._near(text, disclosure.base_spans(text), 6)
    assert [t[0] for t in found] == ["zed", "x" * 200, "one", "two", "three", "four", "y" * 400, "five"]
    many = "1.2.3.4 a@b.co " * 20_000
    assert sum(1 for _ in disclosure._near(many, disclosure.base_spans(many), 6)) == 40_000
