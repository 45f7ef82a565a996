"""Base spans against the plain patterns; disclosure against counts by hand."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlane.llm import pii
from tests.llm.conftest import edge_rows, prose

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def passes(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def plain(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text)
        if passes(kind, m.group())
    ]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ %(4\nZ_é2", max_size=60))
def test_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


EXAMPLES = [
    "write to ann.lee+x@mail.example.co.uk. or a@b", "x@y.z@w.v", "@a.b c@d.e.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1112", "tel +49 (0)30 1234-567. +1 +123456789012345678",
    "a" * 300 + "@" + "b" * 300 + ".c", "4" * 40, "+" * 50 + "1 2345678 9", "é4111111111111111é +4١234567890",
]


def test_examples_equal_the_plain_patterns():
    for text in EXAMPLES:
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for run in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "a." * 100_000 + "@b"):
        pii.base_spans(run)


def test_edge_cases(documents):
    rows = edge_rows() + [(30 + i, t) for i, t in enumerate(EXAMPLES)]
    got = pii.find(documents(rows)).collect()
    want = sorted((str(i), pii.listed(plain(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.base) for r in got) == want
    assert pii.find(documents([])).collect() == []


def planted():
    """One address with a telltale word in different surroundings; another without one."""
    rows = [(i, f"{prose(i, 9)} zanzibar jo@corp.example mentions {prose(50 + i, 9)}") for i in range(5)]
    rows += [(10 + i, f"{prose(100 + i, 9)} mentions amy{i}@corp.example zanzib {prose(150 + i, 9)}") for i in range(5)]
    return rows + [(20 + i, prose(200 + i, 40) + " mentions") for i in range(30)]


def test_telltale_terms_are_found_and_removed(documents):
    rows = planted()
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    for doc_id, text in rows:
        terms = [text[t.start : t.end] for t in got[doc_id].terms or ()]
        assert ("zanzibar" in terms) == (doc_id < 5)
        assert "mentions" not in terms and "zanzib" not in terms
    shares = [t.share for t in got[0].terms if rows[0][1][t.start : t.end] == "zanzibar"]
    assert abs(shares[0] - 1.0) < 1e-9
    clean = {r.doc_id: r for r in pii.sanitise(documents(rows)).collect()}
    assert "zanzibar" not in clean[0].text and "<EMAIL>" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[20].text == rows[10][1] and clean[20].source == "s"


def test_copies_prove_nothing(documents):
    rows = [(i, "same words near jo@corp.example in every copy") for i in range(9)] + [(20 + i, prose(i, 20)) for i in range(9)]
    assert all(not r.terms for r in pii.find(documents(rows)).collect())


def test_sanitised_keeps_nulls_and_overlaps(documents):
    kept = pii.sanitise(documents([(1, None), (2, "+4111111111111111 x")])).collect()
    assert {r.doc_id: r.text for r in kept} == {1: None, 2: "+<CARD> x"}
    assert pii.sanitised("ab Cd9 e", [], [{"start": 3, "end": 6, "share": 0.7}]) == "ab xx0 e"


def test_rare_entities_are_judged_by_groups_and_parts(documents):
    """Every address and number stands in one document only."""
    rows = [(i, f"{prose(i, 30)} mail jane{i}.doe@corp{i}.example {prose(50 + i, 40)} quokka, {prose(80 + i, 9)} quokka") for i in range(4)]
    rows += [(10, f"{prose(90, 30)} card 4111 1111 1111 1111 {prose(91, 20)} ends in 1111 {prose(92, 5)}")]
    rows += [(11, f"from rosalind.f@lab.example {prose(93, 40)} Rosalind {prose(94, 30)}")]
    rows += [(100 + i, prose(200 + i, 40) + " mail") for i in range(600)]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}

    def found(doc_id, text):
        return [text[t.start : t.end] for t in got[doc_id].terms or ()]

    for doc_id, text in rows[:4]:
        assert found(doc_id, text) == ["quokka", "quokka"]  # far from the address, and each time
    assert "1111" in found(*rows[4]) and "ends" not in found(*rows[4])
    assert found(*rows[5]) == ["Rosalind"]
    assert all(not got[i].terms for i, _ in rows[6:])
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    assert "quokka" not in clean[0] and "Rosalind" not in clean[11]
