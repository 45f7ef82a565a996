"""Plain one-by-one models of the match passes, for small random inputs."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

CENT = Decimal("0.01")


def allowed(portal_tax):
    share = (portal_tax * Decimal("0.005")).quantize(CENT, rounding="ROUND_HALF_UP")
    return max(Decimal("1.00"), min(share, Decimal("100.00")))


def tokens(number):
    out, run = [], ""
    for ch in number.upper() + " ":
        kind = "a" if "A" <= ch <= "Z" else "d" if ch.isdigit() else ""
        last = "" if not run else ("a" if run[-1].isalpha() else "d")
        if kind and kind == last:
            run += ch
            continue
        if run:
            out.append(str(int(run)) if last == "d" else run)
        run = ch if kind else ""
    return tuple(out)


def affinity(left, right):
    a, b = sorted((tokens(left), tokens(right)), key=len)
    if a == b:
        return 1.0
    extra = b[len(a):]
    return 0.9 if b[: len(a)] == a and len(extra) == 1 and extra[0].isalpha() else None


def exact_walk(books, portal):
    free = {p["line_id"]: p for p in portal}
    pairs = []
    for b in sorted(books, key=lambda x: x["line_id"]):
        for pid in sorted(free):
            p = free[pid]
            if (
                p["supplier_gstin"] == b["supplier_gstin"]
                and tokens(p["invoice_number"]) == tokens(b["invoice_number"])
                and p["igst"] == b["igst"]
            ):
                pairs.append((b["line_id"], pid))
                del free[pid]
                break
    return pairs


def tolerant_walk(books, portal, window=30):
    scored = []
    for b in books:
        for p in portal:
            score = affinity(b["invoice_number"], p["invoice_number"])
            gap = abs((b["invoice_date"] - p["invoice_date"]).days)
            delta = abs(b["igst"] - p["igst"])
            if (
                b["supplier_gstin"] != p["supplier_gstin"]
                or score is None
                or gap > window
                or delta > allowed(p["igst"])
            ):
                continue
            scored.append((-score, delta, gap, b["line_id"], p["line_id"]))
    used, pairs = set(), []
    for _, _, _, b, p in sorted(scored):
        if ("b", b) not in used and ("p", p) not in used:
            used |= {("b", b), ("p", p)}
            pairs.append((b, p))
    return pairs


def random_lines(rng: random.Random, prefix, count, numbers, taxes, days, gstins):
    lines = []
    for i in rng.sample(range(10_000), count):
        lines.append(
            {
                "line_id": f"{prefix}{i}",
                "supplier_gstin": rng.choice(gstins),
                "invoice_number": rng.choice(numbers),
                "invoice_date": dt.date(2026, 1, 1) + dt.timedelta(days=rng.choice(days)),
                "igst": rng.choice(taxes),
            }
        )
    return lines


def to_df(spark, lines):
    rows = [
        (
            x["line_id"], x["supplier_gstin"], x["invoice_number"], x["invoice_date"],
            Decimal(0), Decimal(0), Decimal(0), x["igst"], Decimal(0), "INVOICE", False,
        )
        for x in lines
    ]
    money = "decimal(28,2)"
    return spark.createDataFrame(
        rows,
        "line_id string, supplier_gstin string, invoice_number string, invoice_date date, "
        f"taxable {money}, cgst {money}, sgst {money}, igst {money}, cess {money}, "
        "kind string, reverse_charge boolean",
    )


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def check_char(body):
    total = 0
    for i, ch in enumerate(body):
        product = ALPHABET.index(ch) * (1 + i % 2)
        total += product // 36 + product % 36
    return ALPHABET[-total % 36]


def valid_gstin(gstin):
    shape = "ddaaaaadddda?Za"
    if len(gstin) != 15 or gstin[0] not in "0123" or gstin[12] == "0":
        return False
    for ch, kind in zip(gstin, shape):
        if kind == "d" and not ch.isdigit():
            return False
    if not (gstin[2:7].isalpha() and gstin[7:11].isdigit() and gstin[11].isalpha()):
        return False
    return gstin[13] == "Z" and check_char(gstin[:14]) == gstin[14]


def reconcile_walk(books, portal, as_of):
    """Whole reconciliation as (matched pairs, [(id, class, book, portal, candidates)])."""
    key = lambda x: (x["supplier_gstin"], tokens(x["invoice_number"]))
    by_id = lambda x: x["line_id"]
    rcm_b = sorted((x for x in books if x["reverse_charge"]), key=by_id)
    rcm_p = sorted((x for x in portal if x["reverse_charge"]), key=by_id)
    books = [x for x in books if not x["reverse_charge"]]
    portal = [x for x in portal if not x["reverse_charge"]]
    matched = exact_walk(books, portal)
    free_b = {x["line_id"]: x for x in books}
    free_p = {x["line_id"]: x for x in portal}

    def use(pairs):
        for b, p in pairs:
            del free_b[b], free_p[p]

    use(matched)
    tolerant = tolerant_walk(list(free_b.values()), list(free_p.values()))
    use(tolerant)
    out = []

    def emit(cls, book, line, candidates=()):
        anchor = line or book
        out.append((f"E{len(out) + 1:05d}-{anchor['line_id']}", cls,
                    book and book["line_id"], line and line["line_id"], tuple(candidates)))

    last = {key(x): x for x in rcm_p}
    paired = set()
    for b in rcm_b:
        p = last.get(key(b))
        if p:
            paired.add(p["line_id"])
        emit("RCM", b, p)
    for p in rcm_p:
        if p["line_id"] not in paired:
            emit("RCM", None, p)
    for b in sorted(free_b.values(), key=by_id):
        for p in sorted(free_p.values(), key=by_id):
            if key(b) == key(p):
                emit("AMOUNT_MISMATCH", b, p)
                use([(b["line_id"], p["line_id"])])
                break
    for b in sorted(free_b.values(), key=by_id):
        if valid_gstin(b["supplier_gstin"]):
            continue
        for p in sorted(free_p.values(), key=by_id):
            if tokens(b["invoice_number"]) == tokens(p["invoice_number"]) and b["igst"] == p["igst"]:
                emit("GSTIN_MISMATCH", b, p, [p["line_id"]])
                use([(b["line_id"], p["line_id"])])
                break
    known = {tokens(x["invoice_number"]) for x in books + portal}
    seen = {}
    for p in sorted(portal, key=by_id):
        if p["line_id"] not in free_p:
            seen[key(p)] = p["line_id"]
    for p in sorted(free_p.values(), key=by_id):
        original = p["original_invoice_number"]
        if p["irn_status"] == "CANCELLED":
            emit("CANCELLED_IRN", None, p)
        elif key(p) in seen:
            emit("DUPLICATE", None, p, [seen[key(p)]])
        else:
            seen[key(p)] = p["line_id"]
            unlinked = original is None or tokens(original) not in known
            credit = p["kind"] == "CREDIT_NOTE"
            emit("CREDIT_NOTE_UNLINKED" if credit and unlinked else "MISSING_IN_BOOKS", None, p)
    for b in sorted(free_b.values(), key=by_id):
        day = b["invoice_date"]
        start = day.year - (day.month < 4)
        emit("TIME_BARRED" if as_of > dt.date(start + 1, 11, 30) else "MISSING_IN_2B", b, None)
    return sorted(matched + tolerant), out
