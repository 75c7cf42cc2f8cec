import hashlib
import random
import re

import numpy as np
import pytest

from tallyframe.llm.pii import ACCEPT, KINDS, base_spans, candidates, code_of, fields, fit, mask, redacted, spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x) // 10 + (2 * x) % 10 for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = ["a", "b.c", "@", "@x.y", "mail", ".", "-", " ", "4111111111111111", "4111 1111 1111 1111", "+1 (437) 555-0689", "+", "12", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "00", "é", "(", ")", "378282246310005", "x@y", "_%+", "x.y@a-b.co.uk", "\n", "0000.0.0.0001"]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 12)))
        assert base_spans(text) == brute(text), text
    assert base_spans("a" * 300_000 + "@" + "1" * 300_000) == []
    assert base_spans("@" * 100_000 + "." * 100_000) == []


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth) for r in (0.95, 0.9, 0.85, 0.6)], axis=1) * 2
    codes = np.full(4000, 3)
    for column, base in zip([*votes.T, *np.zeros((4, 4000), int)], (3, 3, 3, 3, 8, 4, 4, 3)):
        codes = codes * base + column
    assert (fields(codes)[:, 1:5] == votes).all()
    distinct, counts = np.unique(codes, return_counts=True)
    model = fit(distinct, counts)
    good = model.reliability[3, :, 1, 2]
    assert good[0] > good[3] and abs(good[0] - 0.95) < 0.05
    assert ((model.probability(codes) > 0.5) == truth).mean() > 0.93


def test_spans_and_masking(spark):
    texts = ["", None, "call +1 (437) 555-0689 or mail x.y@a-b.com", "ip 10.0.0.1 card 4111 1111 1111 1111.", "nothing 12", "tel (437) 555-0689 now"] + ["phone +1 (437) 555-0689"] * 20
    docs = spark.createDataFrame([(k, t, 5, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in spans(docs).collect()}
    for k, t in enumerate(texts):
        want = brute(t or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{KINDS[x]}:{a}:{b}" for a, x, b in want).encode()).hexdigest()
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(x == j for _, x, _ in want) for j in range(4)]
        assert {f"{KINDS[x]}:{a}:{b}" for a, x, b in want} <= set(got[k].spans.split(","))
    assert "phone:4:18" in got[5].spans  # found by the classifier alone
    clean = {r.doc_id: r for r in redacted(docs).collect()}
    assert clean[2].text == "call [PHONE] or mail [EMAIL]" and clean[2].n_chars == 28 and clean[2].spans == "z"
    assert clean[1].text is None and clean[4].text == "nothing 12"
    assert spans(docs.limit(0)).count() == 0 and redacted(docs.limit(0)).count() == 0
    assert mask("abcdef", [(1, 0, 3), (2, 1, 5)]) == "a[EMAIL]f"


def test_addresses_spelled_out_without_digits_are_searched():
    import pyarrow as pa

    from tallyframe.llm.pii import _LOOSE_EMAIL, _suspects

    texts = [f"write to jane{at}example{dot}com please" for at in (" at ", "[at]", " (AT) ") for dot in ("[dot]", "(DOT)", " [dot] ", " dot ")]
    assert all(_LOOSE_EMAIL.search(t) for t in texts)
    assert _suspects(pa.array([*texts, "nothing to see"])).tolist() == [True] * len(texts) + [False]


def planted_corpus(seed, n):
    """Texts, planted looser candidates (addresses spelled out, phones without a plus) and things that only look like some."""
    rng = random.Random(seed)
    docs, planted, traps = [], [], []
    words = "the report was sent by our office in spring and shows how many people came to see the garden near the old bridge".split()
    prose = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b)))
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    name = lambda: rng.choice("jane tom amy li omar eva max nina".split()) + rng.choice(["", ".k", "_99", "42"])
    domain = lambda: rng.choice("example mailbox garden-club blueriver northwind".split())

    def add(lead, span, kind):
        text = f"{prose(5, 60)} {rng.choice(lead)}"
        if kind is not None:
            kind.append((len(docs), len(text), len(text) + len(span)))
        docs.append(f"{text}{span} {prose(3, 20)}")

    for _ in range(n):
        kind, top = rng.random(), rng.choice("com org net de io".split())
        a, b = rng.randint(201, 989), rng.randint(201, 989)
        if kind < 0.12:
            add(["mail ", "contact ", "write to "], f"{name()}@{domain()}.{top}", None)
        elif kind < 0.20:
            add(["call ", "phone: "], f"+{rng.choice([1, 44, 49])} {a} {b} {digits(4)}", None)
        elif kind < 0.27:
            add(["server ", "from ip "], ".".join(str(rng.randint(1, 254)) for _ in range(4)), None)
        elif kind < 0.35:
            add(["mail ", "contact ", "write to ", "email: "], f"{name()}{rng.choice([' at ', '[at]', ' [at] ', '(at)'])}{domain()}{rng.choice([' dot ', '[dot]'])}{top}", planted)
        elif kind < 0.43:
            add(["call ", "phone ", "tel: ", "fax "], rng.choice([f"({a}) {b}-{digits(4)}", f"{a}-{b}-{digits(4)}", f"{a}.{b}.{digits(4)}"]), planted)
        elif kind < 0.50:
            add(["version ", "release ", "build "], f"{digits(2)}.{digits(3)}.{digits(1)}.{rng.randint(256, 900)}", traps)
        elif kind < 0.56:
            span = " ".join(digits(4) for _ in range(4))
            add(["order ", "invoice ", "id ", "no "], span, None if brute(span) else traps)
        elif kind < 0.62:
            add(["page ", "isbn ", "section "], f"{digits(2)}-{digits(3)}-{digits(5)}", traps)
        else:
            docs.append(prose(10, 80) + rng.choice(["", " meet at noon dot then"]))
    return docs, planted, traps


def added(texts):
    """(text, start, end) of the spans that the classifier adds, trained on these texts."""
    found = [candidates(t) for t in texts]
    codes = [code_of(t, *x) for t, (base, _) in zip(texts, found) for x in base] + [x[3] for _, loose in found for x in loose]
    model = fit(*np.unique(codes, return_counts=True))
    return {(k, x[0], x[2]) for k, (_, loose) in enumerate(found) for x in loose if model.probability(np.array([x[3]]))[0] >= ACCEPT}


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_precision_of_added_spans(seed):
    texts, planted, traps = planted_corpus(seed, 2500)
    got = added(texts)
    meets = lambda a, b: a[0] == b[0] and min(a[2], b[2]) - max(a[1], b[1]) >= 0.7 * (b[2] - b[1])
    recall = np.mean([any(meets(g, p) for g in got) for p in planted])
    precision = np.mean([any(meets(g, p) for p in planted) for g in got])
    assert len(planted) > 300 and len(traps) > 300 and recall >= 0.95 and precision >= 0.95, (recall, precision)
    assert not any(meets(g, t) for g in got for t in traps)


def test_a_failed_checksum_or_range_is_never_added_however_few_texts_there_are():
    texts = ["card 4111 1111 1111 1112 now", "ip 10.0.0.300 down", "visa: 5500-0000-0000-0005 x", "login from 999.1.1.1"] + ["mail a@b.com"] * 13 + ["ip 10.0.0.1", "card 4111 1111 1111 1111"] * 6
    assert added(texts) == set() and added(texts[:4]) == set() and added(texts[:1]) == set()


def test_prose_with_bare_signs_is_no_address():
    from tallyframe.llm.pii import candidates

    prose = ["meet at noon dot com", "we look at it dot then", "contact us at noon dot whatever", "stay at home dot com said the sign"]
    assert not any(candidates(t)[1] for t in prose)
    spelled = ["write to jane at example dot com please", "mail: jane at example dot co dot uk", "jane [at] example dot com", "jane at example [dot] zz"]
    assert [len(candidates(t)[1]) for t in spelled] == [1] * 4
